"""Tables that a stream writes batch by batch, so that a batch that is run again replaces what it wrote and every row is there once."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class BatchTable:
    """A folder with one table for each batch, in the shared folder."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: str):
        self.spark, self.path, self.schema = spark, f"{root.rstrip('/')}/{name}", schema

    def write(self, rows: DataFrame, batch: int) -> DataFrame:
        """The batch's rows, written and read again; a table that an earlier try left is replaced."""
        path = f"{self.path}/batch={batch}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def batch(self, batch: int) -> DataFrame:
        path = f"{self.path}/batch={batch}"
        return self.spark.read.schema(self.schema).parquet(path) if self._exists(path) else self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        """All batches' rows, with column batch."""
        schema = f"{self.schema}, batch long"
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(self.path) if self._exists(self.path) else self.spark.createDataFrame([], schema)

    def forget(self, batch: int) -> None:
        """Drops the table of a batch that no later one reads."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={batch}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def drain(stream: DataFrame, root: str, each: Callable[[DataFrame, int], None], name: str = "drain"):
    """Runs `each` over the batches of what is there and not yet done; which batches are done is in the checkpoint below root, so a restarted run goes on there. The ended query."""
    q = stream.writeStream.queryName(name).foreachBatch(each).option("checkpointLocation", f"{root.rstrip('/')}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return q
