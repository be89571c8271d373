"""Counts of atoms per interval, against what a counter says."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip, reliable

INTERVAL = 43200.0


def atoms(events: DataFrame) -> DataFrame:
    """One row at the start of each real event, and one at the end of those that last."""
    times = F.when(F.col("duration") > 0, F.array("t", F.col("t") + F.col("duration"))).otherwise(F.array("t"))
    return events.where("NOT fake").withColumn("t", F.explode(times))


def day_intervals(obs: DataFrame, width: float = INTERVAL) -> DataFrame:
    """interval_no, lo, hi: from the first time in one stretch of `width` seconds to the first in the next. One row a stretch."""
    b = obs.groupBy(F.floor(F.col("t") / width).alias("interval_no")).agg(F.min("t").alias("lo"))
    return b.withColumn("hi", F.lead("lo").over(Window.orderBy("interval_no"))).where("hi IS NOT NULL")


def interval_counts(intervals: DataFrame, times: DataFrame, width: float = INTERVAL) -> DataFrame:
    """interval_no, lo, hi, n: how many times lie in (lo, hi]. Intervals meet times by stretches, so no range join is left."""
    cells = intervals.withColumn("cell_", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    per = times.groupBy("t").agg(F.count("*").alias("k")).withColumn("cell_", F.floor(F.col("t") / width))
    n = cells.join(per, "cell_").where("t > lo AND t <= hi").groupBy("interval_no").agg(F.sum("k").alias("n"))
    return intervals.join(n, "interval_no", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def audit(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """intervals, unresolved (sum of absolute differences), exact, quiet, worst."""
    j = expected.select("interval_no", F.col("n").alias("e")).join(actual.select("interval_no", "n"), "interval_no")
    gap = F.abs(F.col("e") - F.col("n"))
    return j.agg(F.count("*").alias("intervals"), F.sum(gap).alias("unresolved"), F.count_if(F.col("e") == F.col("n")).alias("exact"), F.count_if((F.col("e") == 0) & (F.col("n") == 0)).alias("quiet"), F.max(gap).alias("worst"))


def curve_loss(obs: DataFrame) -> DataFrame:
    """Weighted absolute error of a running count against the number of rows so far, and the share of exact rows."""
    w = Window.partitionBy("track").orderBy("t", "id")
    n, seen = F.row_number().over(w), F.sum(F.when(F.col("kind").isin("click", "view"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    c = obs.withColumn("gap", F.abs(n - seen)).withColumn("weight", clip((F.col("y") / 100.0 - 0.015) / 0.075, 0.15, 1.0))
    return c.groupBy("track").agg(F.round(F.sum(F.col("weight") * F.col("gap")), 4).alias("loss"), F.round(F.avg(F.when(F.col("gap") == 0, 1.0).otherwise(0.0)), 5).alias("exact"))


def monotone_readings(readings: DataFrame, key: str) -> DataFrame:
    """Reliable readings (key, t, count, error, margin) that are not below one before them."""
    w = Window.partitionBy(key).orderBy("t", "count").rowsBetween(Window.unboundedPreceding, -1)
    r = readings.where(reliable(F.col("error"), F.col("margin"))).withColumn("top_", F.max("count").over(w))
    return r.where(F.col("top_").isNull() | (F.col("count") >= F.col("top_"))).drop("top_")


def anchors(readings: DataFrame, key: str, plateau: float = 0.05) -> DataFrame:
    """key, t, count: where a count is first read, and last, if it stands for more than `plateau` seconds."""
    r = monotone_readings(readings, key).groupBy(key, "count").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    times = F.when(F.col("last") - F.col("first") > plateau, F.array("first", "last")).otherwise(F.array("first"))
    return r.select(key, F.explode(times).alias("t"), "count")
