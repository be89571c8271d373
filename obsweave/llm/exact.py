"""Exact deduplication by distributed MSD radix partitioning.

Texts without white space are split by length and leading bytes, then by the next bytes, and so on, until a group has
one row or its texts have ended. Digits widen from round to round (64 bytes, 4 KB, 256 KB, ...), so a round for
every depth is a job over the rows that are still undecided. Rows are grouped by the bytes themselves: equality needs no digest.
A fixed-size bit filter over (length, first bytes) lets rows that are alone from the start leave where they are read."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, filter_bits, in_filter, input_bytes, text_slices, twice_seen

DROP = bytes([32, *range(9, 14)])
FIRST = 64
WIDEN = 64


def first_digit(norm: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(len(norm).to_bytes(8, "little") + norm[:FIRST], digest_size=8).digest(), "little")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Null texts count as empty, and all empty texts are one group. Of a group the row with the most code points in its
    original text stays, then the smallest doc_id (null last), then one of the rows that agree in both: exactly one
    row of each group is kept. Rows may repeat. `order_col`: another integer column than the id that settles ties."""
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[order_col or id_col].cast("long").alias("tie"))
    spark = docs.sparkSession
    stage = Stage(spark, "exact")

    def hashes(batches):
        for t in text_slices(batches):
            yield np.array([first_digit(x.translate(None, DROP)) for x in t.blobs()], np.uint64)

    bits = spark.sparkContext.broadcast(twice_seen(base, hashes, input_bytes(base) / 100, filter_bits(input_bytes(base) / 256, 25)))

    def split(batches: Iterator[pa.RecordBatch], alone: bool) -> Iterator[pa.RecordBatch]:
        for t, tie in text_slices(batches, True):
            norm = [x.translate(None, DROP) for x in t.blobs()]
            may = in_filter(bits.value, np.array([first_digit(x) for x in norm], np.uint64))
            pick = np.flatnonzero(~may if alone else may)
            ids, at = t.id_array().take(pa.array(pick)), pick.tolist()
            sha = pa.array([hashlib.sha256(norm[i]).hexdigest() for i in at], pa.string())
            if alone:
                yield pa.RecordBatch.from_arrays([ids, ids, pa.array([1] * len(at), pa.int64()), pa.array([True] * len(at), pa.bool_()), sha], ["doc_id", "keep_id", "group_size", "kept", "text_sha256"])
            else:
                heads = np.concatenate([[0], np.cumsum((t.buf & 0xC0) != 0x80)])
                points = (heads[t.off[1:]] - heads[t.off[:-1]])[pick]
                yield pa.RecordBatch.from_arrays([ids, tie.take(pa.array(pick)), sha, pa.array(points, pa.int64()), pa.array([len(norm[i]) for i in at], pa.int64()), pa.array([norm[i] for i in at], pa.binary())], ["doc_id", "tie", "sha", "points", "length", "norm"])

    out = base.mapInArrow(lambda b: split(b, True), "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string")
    cur = stage.write(base.mapInArrow(lambda b: split(b, False), "doc_id long, tie long, sha string, points long, length long, norm binary").withColumn("row", F.monotonically_increasing_id()).withColumn("grp", F.lit(0).cast("long")), "rows")
    depth, width, k = 0, FIRST, 0
    while not cur.isEmpty():
        keyed = cur.withColumn("digit", F.substring("norm", depth + 1, width))
        rank = F.struct("points", (-F.coalesce(F.col("tie"), F.lit(2**63 - 1))).alias("order"), (-F.col("row")).alias("r"), "doc_id")
        groups = stage.write(keyed.groupBy("grp", "length", "digit").agg(F.count("*").alias("n"), F.max(rank).alias("best")).withColumn("next", F.monotonically_increasing_id()), f"groups-{k}")
        met = keyed.join(groups, ["grp", "length", "digit"])
        over = (F.col("n") == 1) | (F.col("length") <= depth + width)
        done = stage.write(met.where(over).select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == -F.col("best.r")).alias("kept"), F.col("sha").alias("text_sha256")), f"done-{k}")
        out = out.union(done)
        cur = stage.write(met.where(~over).select("doc_id", "tie", "sha", "points", "length", "norm", "row", F.col("next").alias("grp")), f"left-{k}")
        depth, width, k = depth + width, width * WIDEN, k + 1
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: DuckDB SQL for the query's rows.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
