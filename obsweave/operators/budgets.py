"""Choices in a total order under budgets and suppression, as rounds over tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import apart, held


def neighbours(df: DataFrame, cells: list[str]) -> DataFrame:
    """Each row in its own and all neighbouring cells."""
    for c in cells:
        df = df.withColumn(c, F.explode(F.array(*(F.col(c) + d for d in (-1, 0, 1)))))
    return df


def budgeted(offers: DataFrame, budgets: DataFrame, key: str, slot: str, item: str, order: list[str], t: str, places: list[str], dt: float, reach: float, most: int = 1000) -> DataFrame:
    """The offers (key, slot, item, ...) that are taken when all are looked at in order of (slot, order, item): an offer is taken if its slot has budget left, its item hasn't been taken, and nothing taken before it
    lies within `dt` in time and `reach` in place.

    Round by round: an offer is taken once it is the first undecided one of its item and of its neighbourhood and so many offers before it in its slot are taken or undecided that one more fits; it is out once a taken one
    suppresses it, its item is taken or its slot is spent. Neighbourhoods are cells: the first of a cell is a minimum, so no pairs of offers are made, and an offer only meets taken ones, of which a cell holds few
    as they suppress each other. Every round decides at least the first undecided offer of each neighbourhood. budgets: key, slot, budget, one row a slot."""
    pos = F.struct(F.col(slot).alias("s"), *(F.col(o).alias(f"o{k}") for k, o in enumerate(order)), F.col(item).alias("i"))
    cells = ["c0_", *(f"c{k + 1}_" for k in range(len(places)))]
    placed = offers.join(budgets.select(key, slot, "budget").where("budget > 0"), [key, slot])
    for c, name, width in zip(cells, [t, *places], [dt, *([reach] * len(places))]):
        placed = placed.withColumn(c, F.floor(F.col(name) / width))
    left = held(placed.withColumn("pos_", pos).withColumn("before_", F.lit(0).cast("long")))  # before_: taken offers of the slot that come earlier
    done = []
    for _ in range(most):
        # who is first in its cells and of its item, and fits
        first = left.groupBy(key, *cells).agg(F.min("pos_").alias("p"))
        near = neighbours(first, cells).groupBy(key, *cells).agg(F.min("p").alias("near_"))
        w = Window.partitionBy(key, slot).orderBy("pos_").rowsBetween(Window.unboundedPreceding, -1)
        ahead = left.withColumn("ahead_", F.coalesce(F.count("*").over(w), F.lit(0)) + F.col("before_")).withColumn("own_", F.min("pos_").over(Window.partitionBy(key, item)))
        ready = ahead.join(near, [key, *cells]).where((F.col("pos_") <= F.col("near_")) & (F.col("pos_") == F.col("own_")) & (F.col("ahead_") < F.col("budget")))
        taken = held(ready.select(*left.columns))
        done.append(taken)
        # what that leaves
        rest = apart(left.join(taken.select(key, item).distinct(), [key, item], "left_anti"))
        new = taken.select(key, *cells, *(F.col(c).alias(f"{c}_t") for c in (t, *places)))
        hit = rest.join(neighbours(new, cells), [key, *cells])
        gap = sum((F.col(p) - F.col(f"{p}_t")) * (F.col(p) - F.col(f"{p}_t")) for p in places)
        hit = hit.where((F.abs(F.col(t) - F.col(f"{t}_t")) < dt) & (gap < reach * reach)).select(key, "pos_").distinct()
        rest = rest.join(apart(hit), [key, "pos_"], "left_anti")
        spent = taken.select(key, slot, F.col("pos_").alias("at_"))
        spent = rest.select(key, slot, "pos_").join(spent, [key, slot]).where("at_ < pos_").groupBy(key, "pos_").agg(F.count("*").alias("n_"))  # at most a budget of taken ones a slot
        rest = rest.join(apart(spent), [key, "pos_"], "left").withColumn("before_", F.col("before_") + F.coalesce("n_", F.lit(0))).drop("n_")
        left = held(rest.where("before_ < budget").select(*left.columns))
        if left.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*offers.columns)
