"""Sessions by gap, over tables and over streams."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from .batches import BatchTable, drain

SESSION = "user_id long, t0 timestamp_ntz, n long"
OPEN = "user_id long, t0 timestamp_ntz, t1 timestamp_ntz, n long"


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """user_id, t0, n: runs of events no further apart than `gap`."""
    s = events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.min("ts").alias("t0"))
    return s.select("user_id", "t0", "n")


def joined(parts: DataFrame, gap: str) -> DataFrame:
    """Parts of sessions (user_id, t0, t1, n) no further apart than `gap` as one."""
    w = Window.partitionBy("user_id").orderBy("t0", "t1")
    reach = F.max("t1").over(w.rowsBetween(Window.unboundedPreceding, -1)) + F.expr(f"INTERVAL {gap}")
    runs = parts.withColumn("new_", F.coalesce(F.col("t0") > reach, F.lit(True)).cast("int")).withColumn("run_", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("user_id", "run_").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sum("n").alias("n")).select("user_id", "t0", "t1", "n")


class SessionStream:
    """Sessions of a stream of events (user_id, ts), appended once they can't grow.

    A batch joins its events to the sessions that are still open. Those that ended more than gap + late before the newest event so far are closed: they go to `closed` and out of the state, which is a
    table, `open`, of the batch. Events older than that, measured by the batches before, come too late for their session and go to `late`. All three are functions of the batch's rows and of the
    batch before, and a batch writes tables of its own, so a run that was killed at any point and started again writes the same tables, and each session is there once."""

    def __init__(self, spark: SparkSession, root: str, gap: str, late: str):
        self.spark, self.root, self.gap, self.delay = spark, root, gap, late
        self.closed, self.open = BatchTable(spark, root, "closed", SESSION), BatchTable(spark, root, "open", OPEN)
        self.late, self.newest = BatchTable(spark, root, "late", "user_id long, ts timestamp_ntz"), BatchTable(spark, root, "newest", "ts timestamp_ntz")

    def each(self, rows: DataFrame, k: int) -> None:
        if rows.isEmpty():
            rows = rows.limit(0)
        before = self.newest.batch(k - 1).agg(F.max("ts")).first()[0]  # one row
        rows = rows.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
        after = self.newest.write(rows.select("ts").union(self.newest.batch(k - 1)).agg(F.max("ts").alias("ts")), k).first()[0]
        past = F.coalesce(F.col("ts") < F.lit(before).cast("timestamp_ntz") - F.expr(f"INTERVAL {self.delay}"), F.lit(False))
        self.late.write(rows.where(past), k)
        new = rows.where(~past).groupBy("user_id", F.col("ts").alias("t0")).agg(F.max("ts").alias("t1"), F.count("*").alias("n"))
        all_open = joined(self.open.batch(k - 1).unionByName(new), self.gap)
        # whether the session can still grow: an event that is not late may come within the gap
        over = F.coalesce(F.col("t1") + F.expr(f"INTERVAL {self.gap}") < F.lit(after).cast("timestamp_ntz") - F.expr(f"INTERVAL {self.delay}"), F.lit(False))
        both = all_open.withColumn("over_", over).persist()
        self.closed.write(both.where("over_").select("user_id", "t0", "n"), k)
        self.open.write(both.where("NOT over_").select("user_id", "t0", "t1", "n"), k)
        both.unpersist()
        for table in (self.open, self.newest):
            table.forget(k - 2)

    def run(self, stream: DataFrame):
        return drain(stream, self.root, self.each, "sessions")

    def all(self) -> DataFrame:
        """user_id, t0, n: closed sessions and those still open."""
        last = self.open.rows().agg(F.max("batch")).first()[0]
        still = self.open.batch(last) if last is not None else self.open.batch(-1)
        return self.closed.rows().select("user_id", "t0", "n").unionByName(still.select("user_id", "t0", "n"))


def stream_sessions(spark: SparkSession, path: str, gap: str, late: str = "30 days") -> DataFrame:
    """The sessions of a stream of files in a folder, or of one file, when all input has been read."""
    source, only = folder(spark, path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    stream = stream.option("pathGlobFilter", only) if only else stream
    s = SessionStream(spark, shared_folder(spark, "sessions"), gap, late)
    s.run(stream.parquet(source).select("user_id", "ts"))
    return s.all()


def folder(spark: SparkSession, path: str) -> tuple[str, str | None]:
    """The folder to watch, and the one file's name if `path` is a file."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return path, None
    return path.rpartition("/")[0], p.getName()
