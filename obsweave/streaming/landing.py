"""A folder that uploads land in, as a stream: each file goes once to the table of accepted or of rejected ones."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.frames import valid_upload
from .batches import BatchTable, drain

FILE = "path string, name string, length long, changed timestamp, judge_y double, threshold int, title string"
#: Parameters of an upload that comes without any.
JUDGE_Y, THRESHOLD, TITLE = 0.82361, 168, "Video reconstruction"
LISTED = "path string, modificationTime timestamp, length long, content binary"


class Landing:
    """accepted, and rejected with a reason: files of a folder, with parameters of tickets (name, judge_y, threshold, title), if any. A file's content is not read.

    Uploads are to be moved into the folder when they are complete. Spark's file streams pass over files without bytes for good, so those are listed at the end of a run and kept as batch -1 of the rejected ones."""

    def __init__(self, spark: SparkSession, folder: str, root: str, tickets: DataFrame | None = None, pattern: str = "*", kinds: tuple[str, ...] = ("raw", "mp4")):
        self.spark, self.folder, self.root, self.pattern, self.kinds = spark, folder, root, pattern, kinds
        self.tickets = tickets
        self.accepted, self.rejected = BatchTable(spark, root, "accepted", FILE), BatchTable(spark, root, "rejected", f"{FILE}, reason string")

    def checked(self, files: DataFrame) -> DataFrame:
        name = F.element_at(F.split("path", "/"), -1)
        f = files.select("path", name.alias("name"), "length", F.col("modificationTime").alias("changed"))
        empty = self.spark.createDataFrame([], "name string, judge_y double, threshold int, title string")
        f = f.join(self.tickets if self.tickets is not None else empty, "name", "left")
        f = f.withColumn("judge_y", F.coalesce("judge_y", F.lit(JUDGE_Y))).withColumn("threshold", F.coalesce("threshold", F.lit(THRESHOLD)))
        f = f.withColumn("title", F.coalesce(F.nullif(F.substring(F.trim("title"), 1, 120), F.lit("")), F.lit(TITLE)))
        kind = F.lower(F.element_at(F.split("name", r"\."), -1))
        size = (F.col("length") > 0) & (F.col("length") <= 2 << 30)
        ok = valid_upload(F.col("length"), F.col("judge_y"), F.col("threshold"))
        reason = F.when(~kind.isin(*self.kinds), "kind").when(~size, "size").when(~ok, "parameters")
        return f.select(*(c.split()[0] for c in FILE.split(", ")), reason.alias("reason"))

    def each(self, files: DataFrame, k: int) -> None:
        rows = self.checked(files)
        self.accepted.write(rows.where("reason IS NULL").drop("reason"), k)
        self.rejected.write(rows.where("reason IS NOT NULL"), k)

    def run(self, most: int = 1000):
        """Takes what has landed since the last run, up to `most` files a batch."""
        stream = self.spark.readStream.format("binaryFile").schema(LISTED).option("pathGlobFilter", self.pattern).option("maxFilesPerTrigger", most).load(self.folder)
        q = drain(stream.select("path", "modificationTime", "length"), self.root, self.each, "landing")
        self.rejected.write(self.checked(self.empty()).where("reason IS NOT NULL"), -1)
        return q

    def empty(self) -> DataFrame:
        """Files without bytes that are there now."""
        jvm = self.spark.sparkContext._jvm
        here = jvm.org.apache.hadoop.fs.Path(f"{self.folder.rstrip('/')}/{self.pattern}")
        found = here.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(here)
        rows = [(f.getPath().toString(), f.getModificationTime(), 0) for f in found if f.isFile() and not f.getLen()]
        return self.spark.createDataFrame(rows, "path string, ms long, length long").select("path", F.timestamp_millis("ms").alias("modificationTime"), "length")
