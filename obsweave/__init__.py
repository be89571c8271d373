"""Observation analytics and corpus preparation on PySpark."""
