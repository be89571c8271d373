"""The folder that the driver and all executors share: spark.checkpoint.dir."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; the temporary folder only for a session in one process without that setting."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}"
    return root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder there."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def held(df: DataFrame) -> DataFrame:
    """The rows as they are now, in their partitions, written to the shared folder; lineage is cut there, and lost executors lose nothing."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_root(spark)}/held")
    return df.checkpoint()


def apart(df: DataFrame) -> DataFrame:
    """The same rows under columns of their own, so that Spark can tell them from those of a table that both come from."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))
