"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document has an exponential key -ln(u) / weight, u uniform and fixed by doc_id and seed, weight its quality. A
source's documents in order of their keys are a weighted sample without replacement, whatever its length. Complete
epochs of a source come first; the rest of its target is the longest prefix of that order within the budget, and the one
later document that fits what is left best.

The order of a source is never sorted in one task: keys fall into buckets by their distribution, which follows from the source's weights
(the mean of 1 - exp(-key * weight)) and makes buckets even; buckets have prefix sums, and only within a bucket are rows sorted. The number of buckets follows
the number of rows."""
from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, Texts, splitmix

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
BUCKET_ROWS = 500
STEPS = 4  # kinds of weights that are told apart in a factor of 2, for the buckets


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> dict[str | None, Fraction]:
    """Target of each source in words. Sources by code point, null last, weigh `weights` in turn and share the sum of
    all sizes; one that would exceed `most` times its size stops there, and what is left is shared anew."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weigh = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, out = Fraction(sum(sizes.values())), set(names), {}
    while free:
        unit = left / sum(weigh[s] for s in free)
        over = {s for s in free if unit * weigh[s] > most * sizes[s]}
        if not over:
            out |= {s: unit * weigh[s] for s in free}
            break
        for s in over:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
        free -= over
    return out


def mix(docs: DataFrame, seed: int = 8, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted: a multiple of size).

    Null texts have size 0 and take nothing. Without `weight_col` a document's quality weight is 1/4 + 3/4 of the share of
    different words among its words; weights that are null or not above 0 count as 1/4. Equal keys are ordered by doc_id, then size. The driver gets
    one row for each source. An empty table gives no rows; repeated rows are taken each on its own; further columns are not read."""
    spark = docs.sparkSession
    weight = F.lit(None).cast("double") if weight_col is None else docs[weight_col].cast("double")
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[source_col].cast("string").alias("source"), weight.alias("weight"))

    def key(batches):

        for b in batches:
            for i in range(0, b.num_rows, 512):
                s = b.slice(i, 512)
                t = Texts(s.column(0), s.column(1))
                words = [x.split() for x in t.blobs()]
                size = np.array([len(w) for w in words], np.int64)
                kinds = np.array([len(set(w)) for w in words], np.float64)
                if weight_col is None:
                    w = 0.25 + 0.75 * kinds / np.maximum(size, 1)
                else:
                    w = np.array([x if x is not None and x > 0 else 0.25 for x in s.column(3).to_pylist()], np.float64)
                u = (splitmix(t.ids.astype(np.uint64) ^ splitmix(np.array([seed]))) >> np.uint64(11)).astype(np.float64)
                e = -np.log((u + 0.5) / 2.0**53) / w
                yield pa.RecordBatch.from_arrays([t.id_array(), s.column(2), pa.array(size), pa.array(e), pa.array(w)], ["doc_id", "source", "size", "key", "weight"])

    stage = Stage(spark, "mixing")
    keyed = stage.write(base.mapInArrow(key, "doc_id long, source string, size long, key double, weight double").withColumn("row", F.monotonically_increasing_id()), "keyed")
    kinds = keyed.groupBy("source", F.greatest(F.lit(-64.0), F.least(F.lit(64.0), F.rint(F.log2("weight") * STEPS))).alias("kind")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.avg("weight").alias("weight"))
    by_source = kinds.groupBy("source").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.collect_list(F.struct("weight", "n")).alias("kinds"))
    found = by_source.collect()
    sizes = {r.source: r["size"] for r in found}
    goal = targets(sizes, weights, most)
    rows = []
    for s, n in sizes.items():
        epochs = int(goal[s] // n) if n else 0
        rows.append((s, n, float(goal[s]), epochs, float(goal[s] - epochs * n)))
    plan = spark.createDataFrame(rows, "source string, source_size long, target double, epochs long, budget double")
    spread = spark.createDataFrame([(r.source, r.n, [(k.weight, k.n) for k in r.kinds]) for r in found], "of string, n long, kinds array<struct<weight:double,n:bigint>>")
    buckets = max([1, *(r.n // BUCKET_ROWS for r in found)])
    share = F.aggregate("kinds", F.lit(0.0), lambda acc, k: acc + (1 - F.exp(-F.col("key") * k["weight"])) * k["n"]) / F.col("n")
    placed = keyed.join(spread, F.col("source").eqNullSafe(F.col("of"))).withColumn("bucket", F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("long")).drop("of", "n", "kinds", "weight")
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("before", F.coalesce(before, F.lit(0)))
    sums = sums.join(plan, sums.source.eqNullSafe(plan.source)).select(sums.source, "bucket", "before", "source_size", "target", "epochs", "budget")
    joined = placed.join(sums, placed.source.eqNullSafe(sums.source) & (placed.bucket == sums.bucket)).select(placed["*"], "before", "source_size", "target", "epochs", "budget")
    w = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.col("before") + F.coalesce(F.sum("size").over(w), F.lit(0))
    ranked = stage.write(joined.withColumn("prior", prior), "ranked")
    inside = F.col("prior") + F.col("size") <= F.col("budget")
    # what is left of each budget goes to the one further document whose size comes nearest to it, if that helps
    sampled = F.sum(F.when(inside, F.col("size")).otherwise(0))
    left = ranked.groupBy(F.col("source").alias("of")).agg((F.max("budget") - sampled).alias("rest"))
    outside = ranked.where(~inside & (F.col("size") > 0)).join(left, F.col("source").eqNullSafe(F.col("of"))).where("size < 2 * rest").select("source", F.struct(F.abs(F.col("rest") - F.col("size")), "key", "row").alias("miss"))
    last = outside.groupBy("source").agg(F.min("miss").alias("miss")).select(F.col("miss.row").alias("last"))
    out = ranked.join(last, F.col("row") == F.col("last"), "left")
    taken = (F.col("size") * (F.col("epochs") + F.when(inside | F.col("last").isNotNull(), 1).otherwise(0))).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("epochs") >= most, F.col("size") * most).otherwise(taken).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")
