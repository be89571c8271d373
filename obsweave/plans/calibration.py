"""Calibration over tumbling windows."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import ranged, rows_before


def median(df: DataFrame, value: str) -> DataFrame:
    """One row `median` (null for no rows), exact, without all values in one task: values are counted, dealt out by ranges, and only the one or two values in the
    middle of the cumulative counts are kept."""
    c = ranged(df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n")), ["v"])
    upto = F.sum("n").over(Window.partitionBy("part_").orderBy("in_").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before_")
    c = c.join(F.broadcast(rows_before(c, F.col("n"))), "part_").withColumn("upto", upto)
    holds = lambda at: (F.col("upto") - F.col("n") < at) & (at <= F.col("upto"))
    low, high = F.floor((F.col("all_") + 1) / 2), F.floor(F.col("all_") / 2) + 1
    return c.agg(((F.max(F.when(holds(low), F.col("v"))) + F.max(F.when(holds(high), F.col("v")))) / 2).alias("median"))


def tumbling(obs: DataFrame, width: float, least: int = 4, value: str = "x") -> DataFrame:
    """bucket, n, med, mad for every window between the first and the last; the overall median where a window has `least` rows or fewer."""
    b = obs.withColumn("bucket", F.floor(F.col("t") / width))
    m = b.groupBy("bucket").agg(F.expr(f"percentile({value}, 0.5)").alias("m"), F.count("*").alias("k"))
    d = b.join(m, "bucket").groupBy("bucket").agg(F.expr(f"percentile(abs({value} - m), 0.5)").alias("d"))
    span = b.agg(F.min("bucket").alias("a"), F.max("bucket").alias("z"))
    every = span.join(median(obs, value)).select(F.col("median").alias("nominal"), F.explode(F.sequence("a", "z")).alias("bucket"))  # one row each
    out = every.join(m, "bucket", "left").join(d, "bucket", "left")
    return out.select("bucket", F.coalesce("k", F.lit(0)).cast("long").alias("n"), F.round(F.when(F.col("k") > least, F.col("m")).otherwise(F.col("nominal")), 4).alias("med"), F.round(F.coalesce("d", F.lit(0.0)), 4).alias("mad"))
