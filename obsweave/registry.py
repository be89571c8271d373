"""All observation queries and their SQL."""
from __future__ import annotations

from . import export_queries, fit_queries, motion_queries, path_queries  # noqa: F401  they add their queries
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
