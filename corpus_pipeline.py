"""From raw documents to token ids: toxicity, exact dedup, near dedup, mixing, encoding.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of `documents`."""
from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsweave.llm import bpe, exact, jaccard, mixing, toxicity
from obsweave.llm.common import Stage, id_text

#: The last stage's digests are of token ids, which SQL can't make; tests/llm holds run() against brute force.
ORACLE_SQL = None


_held: list[Stage] = []  # working tables of the step before


def step(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A step that first drops the working tables of the step before: its rows have been written and read again by now. Tables that `docs` still
    reads stay."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        for old in [s for s in _held if not any(s.root.split(":")[-1].lstrip("/") in x for x in read)]:
            old.drop()
            _held.remove(old)
        if _held or read:
            Stage(spark, "none").release()
        before = len(Stage.live)
        out = f(spark, docs, sf_dir)
        _held.extend(Stage.live[before:])
        return out

    return run


def free(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def numbered(docs: DataFrame, stage: Stage) -> tuple[DataFrame, str]:
    """docs with a number for each row, written so that numbers hold, and that column's name. Ids may be null or repeat; numbers don't."""
    row = free(docs, "row")
    return stage.write(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


@step
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the grammar does not reject; it learns from all labels.

    A row is judged by its own text, so repeated rows go or stay together, and a missing doc_id changes nothing; a null or empty text is clean. An empty table
    gives no rows; all columns pass, whatever their names."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(id_text(spark.read.parquet(f"{sf_dir}/documents.parquet")), labels)
    return toxicity.reject(docs, model)


@step
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: the one with the most code points, then the smallest doc_id (null last), then the first row.

    Null and empty texts are one group. Repeated rows are copies; an empty table gives no rows; all columns pass, whatever their names."""
    rows, row = numbered(docs, Stage(spark, "copies"))
    kept = exact.dedup(rows, id_col=row, order_col="doc_id").where("kept").select(F.col("doc_id").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


@step
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of shingle links: the smallest doc_id (null last), then the first row; and every row without shingles.

    Links are between rows, by their texts: repeated rows link, rows that share a doc_id alone don't. An empty table gives no rows; all columns pass, whatever
    their names."""
    stage = Stage(spark, "near")
    rows, row = numbered(docs, stage)
    comps = jaccard.link_components(rows, id_col=row).select(F.col("doc_id").alias(row), "component_id")
    several = comps.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    named = comps.join(several, "component_id").join(rows.select(row, F.col("doc_id").cast("long").alias("named")), row)
    rank = F.struct(F.col("named").isNull().alias("late"), "named", row)
    stay = named.groupBy("component_id").agg(F.min(rank).alias("stay")).select("component_id", F.col(f"stay.{row}").alias("stay"))
    gone = stage.write(named.join(stay, "component_id").where(F.col(row) != F.col("stay")).select(row), "gone")
    return rows.join(gone, row, "left_anti").select(*docs.columns)


@step
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it.

    Rows with one doc_id, null among them, are as often there as the one of them that is taken most. Null and empty texts have no words and are not taken; a null
    source is a source. An empty table gives no rows; all columns pass, whatever their names."""
    stage = Stage(spark, "mix")
    of, times, time = free(docs, "of"), free(docs, "times"), free(docs, "time")
    taken = mixing.mix(docs).where("taken > 0").select("doc_id", (F.col("taken") / F.col("size")).cast("int").alias("times"))
    found = stage.write(taken.groupBy(F.col("doc_id").alias(of)).agg(F.max("times").alias(times)), "times")
    met = docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found[of]))
    return met.withColumn(time, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


@step
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document of the mix.

    Null texts count as empty and have no tokens; rows may repeat or lack a doc_id, and have a row each. An empty table gives no rows; further columns are not read."""
    return bpe.encode(docs, digest=True)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("mixing sources to target weights", mix_sources), ("BPE encoding and decoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each written and read again."""
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, f) in enumerate(STAGES):
        docs = stage.write(f(spark, docs, sf_dir), f"stage-{k}")
        stage.drop(f"stage-{k - 1}")
    return docs
