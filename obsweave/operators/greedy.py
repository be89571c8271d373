"""Ordered greedy operators as folds inside Catalyst; groups are time islands, so that no fold holds more than one island."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import gap_islands


def _fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], step) -> DataFrame:
    """Rows of each key, in order, through step(kept array, row) -> kept array; the kept rows."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in columns if c not in order)))).alias("rows_"))
    empty = F.slice("rows_", 1, 0)
    return rows.select(*keys, F.explode(F.aggregate("rows_", empty, step)).alias("r_")).select(*keys, "r_.*")


def suppress(df: DataFrame, key: str, order: list[str], columns: list[str], near, t: str = "t", reach: float | None = None) -> DataFrame:
    """Non-maximum suppression: rows in `order` (ascending) are kept unless near(kept, row) holds for one kept before. With `reach`, the time beyond
    which `near` never holds, rows are first split into islands that can't affect each other."""
    if reach is not None:
        df = gap_islands(df, [key], t, reach, order[-1], "island_")
    keys = [key, "island_"] if reach is not None else [key]
    out = _fold(df, keys, order, columns, lambda acc, e: F.when(F.exists(acc, lambda q: near(q, e)), acc).otherwise(F.concat(acc, F.array(e))))
    return out.drop("island_")


def monotone(df: DataFrame, keys: list[str], order: list[str], columns: list[str], accept) -> DataFrame:
    """Keeps a row if accept(last kept, row) holds, or nothing is kept yet."""
    return _fold(df, keys, order, columns, lambda acc, e: F.when((F.size(acc) == 0) | accept(F.try_element_at(acc, F.lit(-1)), e), F.concat(acc, F.array(e))).otherwise(acc))


def slots(df: DataFrame, keys: list[str], start: str, end: str, tie: str, slack: float = 0.0) -> DataFrame:
    """First-fit slots: a row takes the first slot whose last end + slack lies before its start, or a new one. Adds `slot` from 0.

    Where all earlier rows have ended every slot is free, so what follows is a group of its own: a fold holds no more than rows that reach into each other."""
    w = Window.partitionBy(*keys).orderBy(start, tie)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("free_", F.when(reach.isNull() | (reach + slack < F.col(start)), 1).otherwise(0))
    df = df.withColumn("run_", F.sum("free_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = df.groupBy(*keys, "run_").agg(F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(tie).alias("i"), F.col(end).alias("e")))).alias("rows_"))
    zero = F.struct(F.expr("CAST(array() AS array<double>)").alias("ends"), F.expr("CAST(array() AS array<struct<i:bigint,slot:int>>)").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        free = F.array_position(F.transform(acc["ends"], lambda e: e + slack < r["s"]), F.lit(True)).cast("int")
        ends = F.when(free > 0, F.transform(acc["ends"], lambda e, k: F.when(k == free - 1, r["e"]).otherwise(e))).otherwise(F.concat(acc["ends"], F.array(r["e"])))
        slot = F.when(free > 0, free - 1).otherwise(F.size(acc["ends"]))
        return F.struct(ends.alias("ends"), F.concat(acc["out"], F.array(F.struct(r["i"].cast("long").alias("i"), slot.cast("int").alias("slot")))).alias("out"))

    return rows.select(*keys, F.explode(F.aggregate("rows_", zero, step)["out"]).alias("o")).select(*keys, F.col("o.i").alias(tie), F.col("o.slot").alias("slot"))


def ranked(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """`rank` from 1 in each key, for budgets that take the first so many."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
