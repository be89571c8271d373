"""Runs of named stages over one or many videos: tables in a run folder, a manifest of fingerprints, resuming and progress."""
from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Step = Callable[..., DataFrame]


def signature(*parts: object) -> str:
    """sha256 over functions' sources and other values."""
    h = hashlib.sha256()
    for p in parts:
        h.update((inspect.getsource(p) if callable(p) else repr(p)).encode() + b"\0")
    return h.hexdigest()


class Run:
    """Stages in a folder that the driver and all executors share. A stage is a function of the tables of earlier stages; its table is written once, and used again by a
    later run with `resume` if its code, its inputs' fingerprints and its parameters are the same. A manifest row is added when a table is complete, so a stage that was cut off is run again."""

    def __init__(self, spark: SparkSession, folder: str, source: DataFrame, key: str, resume: bool = True):
        self.spark, self.folder, self.resume = spark, folder.rstrip("/"), resume
        self.tables: dict[str, DataFrame] = {"source": source}
        self.marks: dict[str, str] = {"source": key}
        self.done: list[dict] = []

    def add(self, name: str, table: DataFrame, key: str) -> None:
        """A further source; key: its fingerprint."""
        self.tables[name], self.marks[name] = table, key

    def path(self, *parts: str) -> str:
        return "/".join([self.folder, *parts])

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def manifest(self) -> DataFrame:
        """stage, fingerprint, rows: complete tables of this and earlier runs."""
        path = self.path("manifest")
        schema = "stage string, fingerprint string, rows long"
        return self.spark.read.schema(schema).json(path) if self._exists(path) else self.spark.createDataFrame([], schema)

    def stage(self, name: str, step: Step, *inputs: str, **options) -> DataFrame:
        """The table of step(*inputs' tables, **options)."""
        mark = signature(step, [self.marks[i] for i in inputs], sorted(options.items()))
        path = self.path("tables", f"{name}-{mark[:16]}")
        known = self.resume and self._exists(f"{path}/_SUCCESS") and not self.manifest().where((F.col("stage") == name) & (F.col("fingerprint") == mark)).isEmpty()
        if not known:
            step(*(self.tables[i] for i in inputs), **options).write.mode("overwrite").parquet(path)
            rows = self.spark.read.parquet(path).count()
            self.spark.createDataFrame([(name, mark, rows)], "stage string, fingerprint string, rows long").coalesce(1).write.mode("append").json(self.path("manifest"))
        self.tables[name], self.marks[name] = self.spark.read.parquet(path), mark
        self.done.append({"stage": name, "reused": bool(known)})
        return self.tables[name]

    def progress(self) -> str:
        """What is done, as JSON."""
        return json.dumps({"stages": [d["stage"] for d in self.done], "reused": [d["stage"] for d in self.done if d["reused"]]})


def batch_report(runs: DataFrame) -> DataFrame:
    """video, state, detail of every run (video, error): those that succeeded first, by name, then the failures."""
    r = runs.select("video", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("state"), F.substring(F.coalesce("error", F.lit("")), 1, 120).alias("detail"))
    return r.orderBy("state", "video")
