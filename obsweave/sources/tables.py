"""Adapters from event and sales tables to observations, holds and counters."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str):
    """Seconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ)) / 1000000.0D")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, id, t, x, y, kind from `events`: one row a detection."""
    y = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), F.col("event_id").alias("id"), seconds("ts").alias("t"), F.col("value").alias("x"), y.alias("y"), F.col("event_type").alias("kind"))


def holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, t, duration, fake and score inputs from `lineitem`: one row an event that may last."""
    li = table(spark, sf_dir, "lineitem")
    duration = F.when(F.col("l_linestatus") == "O", F.col("l_quantity") * 86400).otherwise(0.0)
    return li.select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), seconds("l_shipdate").alias("t"), duration.alias("duration"), (F.col("l_returnflag") == "R").alias("fake"), F.col("l_discount").alias("ring"), F.col("l_tax").alias("head"), F.col("l_quantity").alias("frames"), F.col("l_extendedprice").alias("price"))


def read_stage(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    """A stage file, by a declared schema."""
    return spark.read.schema(schema).format(kind).load(path)


def write_stage(df: DataFrame, path: str, kind: str = "parquet", order: list[str] | None = None) -> None:
    """A stage file; CSV has a header, its columns in `order`, and arrays, structs and maps as JSON."""
    out = df.select(*order) if order else df
    if kind == "csv":
        nested = ("array", "struct", "map")
        out = out.select(*(F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() in nested else F.col(f.name) for f in out.schema))
    out.write.mode("overwrite").option("header", True).option("escape", '"').format(kind).save(path) if kind == "csv" else out.write.mode("overwrite").format(kind).save(path)


def unfinished(sources: DataFrame, finished: DataFrame, key: str = "video") -> DataFrame:
    """Batch source: what has no verified output yet."""
    return sources.join(finished, key, "left_anti")


def fingerprint(*columns: str):
    """Content key of a cached stage: sha256 over the columns."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def reusable(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """Stages whose fingerprint the run manifest has with all outputs there."""
    return wanted.join(manifest.where("complete").select("stage", "fingerprint"), ["stage", "fingerprint"], "left_semi")
