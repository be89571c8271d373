"""Template banks: prototypes by medians, nearest template with the margin to the second."""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import held


def prototypes(vectors: DataFrame) -> DataFrame:
    """label, i, m: the median of each position of a label's vectors."""
    return vectors.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", (F.col("i") + 1).cast("long").alias("i")).agg(F.expr("percentile(CAST(v AS DOUBLE), 0.5)").alias("m"))


#: Prototypes that are sent to all tasks at once.
MOST = 4096


def passes(bank: DataFrame, most: int = MOST) -> list[DataFrame]:
    """A bank (label, ...) as parts of `most` rows at most, each small enough to be sent to all tasks; one part unless there are more labels than that."""
    n = bank.count()
    if n <= most:
        return [F.broadcast(bank)]
    rows = held(bank.withColumn("part_", F.floor((F.row_number().over(Window.orderBy("label")) - 1) / most)))  # a row a label
    return [F.broadcast(rows.where(F.col("part_") == k).drop("part_")) for k in range(math.ceil(n / most))]


def best_two(scores: DataFrame, places: int = 6, key: str = "vec_id") -> DataFrame:
    """The two rows (label, err) of each key with the least error, rounded to so many places, then the least label, as k = 1 and 2."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(F.round("err", places), "label"))
    return scores.select(key, "label", "err").withColumn("k", k).where("k <= 2")


def classify(vectors: DataFrame, most: int = MOST) -> DataFrame:
    """vec_id, best, err, margin: the label whose prototype has the least mean squared error, and how much larger the second's is. The bank has one row a label."""
    bank = held(prototypes(vectors).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("p")).select("label", F.transform("p", lambda q: q["m"]).alias("p")))
    err = F.aggregate(F.zip_with("embedding", "p", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x) / F.size("p")
    found = [best_two(vectors.select("vec_id", "embedding").crossJoin(part).withColumn("err", err)) for part in passes(bank, most)]
    s = found[0] if len(found) == 1 else best_two(reduce(DataFrame.unionByName, found))
    return s.groupBy("vec_id").agg(F.max(F.when(F.col("k") == 1, F.col("label"))).alias("best"), F.max(F.when(F.col("k") == 1, F.col("err"))).alias("err"), (F.max(F.when(F.col("k") == 2, F.col("err"))) - F.max(F.when(F.col("k") == 1, F.col("err")))).alias("margin"))
