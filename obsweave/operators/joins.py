"""Joins on time and place, each with an equality that Spark can hash or sort on."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import apart


def band_join(left: DataFrame, right: DataFrame, keys: list[str], t: str, low: float, high: float) -> DataFrame:
    """Pairs of equal keys with right.t - left.t in [low, high]. Times fall into buckets as wide as the band, so that each left row meets
    two or three buckets instead of all rows of its key. Right columns get the suffix _r."""
    width = max(high - low, 1e-9)
    r = right.select(*(F.col(c).alias(c if c in keys else f"{c}_r") for c in right.columns)).withColumn("cell_", F.floor(F.col(f"{t}_r") / width))
    l = left.withColumn("cell_", F.explode(F.sequence(F.floor((F.col(t) + low) / width), F.floor((F.col(t) + high) / width))))  # noqa: E741
    return l.join(r, [*keys, "cell_"]).where(F.col(f"{t}_r") - F.col(t) >= low).where(F.col(f"{t}_r") - F.col(t) <= high).drop("cell_")


def argmin_per(df: DataFrame, keys: list[str], cost: Column, *ties: str) -> DataFrame:
    """The row with the least (cost, ties) of each key."""
    w = Window.partitionBy(*keys).orderBy(cost, *ties)
    return df.withColumn("rank_", F.row_number().over(w)).where("rank_ = 1").drop("rank_")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], t: str, columns: list[str], forward: bool = False) -> DataFrame:
    """Each left row with the last right row at or before its time (forward: the first at or after): a union and one window, no range join. Right columns
    get the suffix _r; ties within the right side go to the greatest struct of its columns (least, if forward)."""
    rs = F.struct(*(F.col(c) for c in [t, *columns]))
    r = right.groupBy(*keys, t).agg((F.min if forward else F.max)(rs).alias("r_")).select(*keys, F.col(t).alias("t_"), "r_", F.lit(None).cast(left.select(F.struct("*").alias("l")).schema["l"].dataType).alias("l_"))
    l = left.select(*keys, F.col(t).alias("t_"), F.lit(None).cast(r.schema["r_"].dataType).alias("r_"), F.struct("*").alias("l_"))  # noqa: E741
    w = Window.partitionBy(*keys).orderBy(F.desc("t_") if forward else "t_")  # backward in time, the first at or after comes last
    hit = F.last("r_", True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    both = r.unionByName(l).withColumn("hit_", hit).where("l_ IS NOT NULL")
    return both.select("l_.*", *(F.col(f"hit_.{c}").alias(f"{c}_r") for c in [t, *columns]))


def grid_semi(left: DataFrame, right: DataFrame, cells: dict[str, float], anti: bool = False) -> DataFrame:
    """Left rows with (anti: without) a right row in their own or a neighbouring cell of a grid; cells: column -> width."""
    key = [F.rint(F.col(c) / w).cast("long") for c, w in cells.items()]
    names = [f"g{k}_" for k in range(len(cells))]
    r = right.select(*(k.alias(n) for k, n in zip(key, names))).distinct()
    for n in names:  # neighbours of the few distinct cells, not of the rows
        r = r.withColumn(n, F.explode(F.array(*(F.col(n) + d for d in (-1, 0, 1)))))
    l = left.select("*", *(k.alias(n) for k, n in zip(key, names)))  # noqa: E741
    return l.join(r.distinct(), names, "left_anti" if anti else "left_semi").drop(*names)


def tolerant_anti(left: DataFrame, right: DataFrame, keys: list[str], places: list[str], reach: int) -> DataFrame:
    """Left rows without a right row of equal keys whose places (integers) all lie within `reach`. Right rows go to the cells they can reach, so the join is by equality."""
    width = 2 * reach + 1
    r = right.select(*keys, *(F.col(p).alias(f"{p}_r") for p in places))
    probe = left.select(*keys, *places).distinct()  # rows are told apart by what they hold: numbers given to them need not be the same when they are read twice
    for k, p in enumerate(places):
        r = r.withColumn(f"c{k}_", F.floor(F.col(f"{p}_r") / width))
        probe = probe.withColumn(f"c{k}_", F.explode(F.array_distinct(F.array(F.floor((F.col(p) - reach) / width), F.floor((F.col(p) + reach) / width)))))
    near = probe.join(r, [*keys, *(f"c{k}_" for k in range(len(places)))])
    for p in places:
        near = near.where(F.abs(F.col(p) - F.col(f"{p}_r")) <= reach)
    return left.join(apart(near.select(*keys, *places).distinct()), [*keys, *places], "left_anti")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], t: str, place: str, rate: float, cell: float, id_col: str = "id") -> DataFrame:
    """Each left row with the right row of its keys that costs least, rate * abs(dt) + abs(dplace), then the least id; without a limit on either. The right rows next to it in time give a
    bound, and only rows within the time that the bound allows are compared, so a row meets its neighbourhood and not all rows of its key. Right columns get the suffix _r."""
    l = left.withColumn("row_", F.monotonically_increasing_id())  # noqa: E741
    bound = F.lit(float("inf"))
    probe = l.select(*keys, t, place, "row_")
    for forward in (False, True):
        probe = as_of(probe, right.select(*keys, t, place), keys, t, [place], forward)
        cost = rate * F.abs(F.col(f"{t}_r") - F.col(t)) + F.abs(F.col(f"{place}_r") - F.col(place))
        probe = probe.withColumn("bound_", F.least(F.coalesce(cost, F.lit(float("inf"))), F.col("bound_") if forward else bound)).drop(f"{t}_r", f"{place}_r")
    reach = F.col("bound_") / rate * (1 + 1e-9) + 1e-9
    probe = probe.where(F.col("bound_") < float("inf")).withColumn("cell_", F.explode(F.sequence(F.floor((F.col(t) - reach) / cell), F.floor((F.col(t) + reach) / cell))))
    r = right.select(*(F.col(c).alias(c if c in keys else f"{c}_r") for c in right.columns)).withColumn("cell_", F.floor(F.col(f"{t}_r") / cell))
    cost = rate * F.abs(F.col(f"{t}_r") - F.col(t)) + F.abs(F.col(f"{place}_r") - F.col(place))
    met = probe.join(r, [*keys, "cell_"]).withColumn("cost", cost).where(F.col("cost") <= F.col("bound_") * (1 + 1e-9) + 1e-9)
    best = argmin_per(met.select("row_", "cost", *(f"{c}_r" for c in right.columns if c not in keys)), ["row_"], F.round("cost", 9), f"{id_col}_r")
    return l.join(best, "row_").drop("row_")


def same_time(left: DataFrame, right: DataFrame, keys: list[str], t: str, columns: list[str], tolerance: float = 1e-5) -> DataFrame:
    """Each left row with the right row nearest in time. A left row without one within `tolerance` stops the query: the next one is never taken instead."""
    both = left
    for forward, mark in ((False, "p"), (True, "n")):
        names = {f"{c}_r": f"{c}_{mark}" for c in [t, *columns]}
        both = as_of(both, right, keys, t, columns, forward).withColumnsRenamed(names)
    before, after = F.col(t) - F.col(f"{t}_p"), F.col(f"{t}_n") - F.col(t)
    first = before.isNotNull() & (after.isNull() | (before <= after))
    gap = F.when(first, before).otherwise(after)
    ok = F.when(F.coalesce(gap <= tolerance, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit(f"no row within {tolerance} s of "), F.col(t).cast("string"))).cast("boolean"))
    out = both.select(*left.columns, *(F.when(ok, F.when(first, F.col(f"{c}_p")).otherwise(F.col(f"{c}_n"))).alias(f"{c}_r") for c in [t, *columns]))
    return out
