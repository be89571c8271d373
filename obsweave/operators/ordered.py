"""Operators on ordered rows of a key: islands, unwrapping, filters, resampling."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import wrap
from ..sources.shared import held


def by(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows from 1; a row for which `starts` holds, or the first, begins a run."""
    w = by(keys, order)
    new = F.when(F.row_number().over(w) == 1, 1).when(starts, 1).otherwise(0)
    return df.withColumn("new_", new).withColumn(name, F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("new_")


def gap_islands(df: DataFrame, keys: list[str], t: str, gap: float, tie: str, name: str = "island") -> DataFrame:
    """Splits where more than `gap` passes between rows."""
    w = by(keys, [t, tie])
    return islands(df, keys, [t, tie], F.col(t) - F.lag(t).over(w) > gap, name)


def value_islands(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "island") -> DataFrame:
    """Splits where `value` changes."""
    return islands(df, keys, order, ~F.col(value).eqNullSafe(F.lag(value).over(by(keys, order))), name)


def median_filter(df: DataFrame, keys: list[str], order: list[str], value: str, reach: int = 1, name: str = "filtered") -> DataFrame:
    """Median over 2 * reach + 1 rows; ends repeat beyond the first and last row."""
    w = by(keys, order)
    first, last = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    around = [F.coalesce(F.lag(value, k).over(w), first) for k in range(reach, 0, -1)] + [F.col(value)] + [F.coalesce(F.lead(value, k).over(w), last) for k in range(1, reach + 1)]
    return df.withColumn(name, F.element_at(F.array_sort(F.array(*around)), reach + 1))


def unwrap(df: DataFrame, keys: list[str], order: list[str], angle: str, turn: float = 360.0, name: str = "unwrapped") -> DataFrame:
    """Adds whole turns so that no step exceeds half a turn."""
    w = by(keys, order)
    step = wrap(F.col(angle) - F.lag(angle).over(w), turn)
    first = F.first(angle).over(w)
    return df.withColumn("step_", F.coalesce(step, F.lit(0.0))).withColumn(name, first + F.sum("step_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("step_")


def interpolate(points: DataFrame, at: DataFrame, key: str = "track", t: str = "t", value: str = "x") -> DataFrame:
    """Values of each key's points at other times, linear between neighbours and constant beyond the ends: no range join, and one sort of the rows of `at`.
    at: (key, t, ...); points: (key, t, value), times distinct within a key."""
    # a point knows the next one, and a row before all times knows the first: so what came last is enough, and no frame reaches ahead, which would be gone through anew for each row
    one = lambda t_, *of: F.struct(t_.alias("t_"), F.struct(*(c.alias(n) for c, n in zip(of, ("t", "v", "t2", "v2")))).alias("p"))
    w, none = Window.partitionBy(key).orderBy("t1_"), F.lit(None).cast("double")
    rows = points.where(F.col(t).isNotNull()).select(key, F.col(t).cast("double").alias("t1_"), F.col(value).cast("double").alias("v1_"))
    rows = rows.select("*", F.lead("t1_").over(w).alias("t2_"), F.lead("v1_").over(w).alias("v2_"), F.row_number().over(w).alias("no_"))
    first = F.when(F.col("no_") == 1, one(F.lit(float("-inf")), none, none, F.col("t1_"), F.col("v1_")))
    p = rows.select(key, F.explode(F.array_compact(F.array(first, one(*(F.col(c) for c in ("t1_", "t1_", "v1_", "t2_", "v2_")))))).alias("o"))
    p = p.select(key, "o.t_", "o.p", F.lit(None).cast(at.select(F.struct("*").alias("r")).schema["r"].dataType).alias("row"))
    q = at.select(key, F.col(t).cast("double").alias("t_"), F.lit(None).cast(p.schema["p"].dataType).alias("p"), F.struct("*").alias("row"))
    before = F.last("p", True).over(Window.partitionBy(key).orderBy("t_").rangeBetween(Window.unboundedPreceding, 0))
    a = F.col("a")
    v = F.when(a.t.isNull(), a.v2).when(a.t2.isNull() | (a.t == F.col("t_")), a.v).otherwise(a.v + (a.v2 - a.v) * (F.col("t_") - a.t) / (a.t2 - a.t))
    return p.unionByName(q).withColumn("a", before).where("row IS NOT NULL").select("row.*", v.alias("interpolated"))


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows dealt out and sorted by ranges of the order, with part_, the range, and in_, the place in it from 1. Ranges come from a sample, so they are settled once: the
    rows are written to the shared folder, and every reader sees the same ranges."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return held(rows.withColumn("part_", F.spark_partition_id()).withColumn("in_", inside))


def rows_before(rows: DataFrame, weight: Column) -> DataFrame:
    """part_, before_, all_: sums of the weight in the ranges before a range and in all of them; a row a range, which is as many as there are tasks."""
    n = rows.groupBy("part_").agg(F.sum(weight).cast("long").alias("n_"))
    w = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    return n.select("part_", F.coalesce(F.sum("n_").over(w), F.lit(0)).alias("before_"), F.sum("n_").over(Window.partitionBy()).alias("all_"))
