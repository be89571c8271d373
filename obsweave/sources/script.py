"""Scripts of many lines as ordered parts: lines are dealt out by ranges of their order, every task writes its own part, and an index says where each part begins, so no task ever holds a script."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.curves import simplify
from ..operators.greedy import slots
from ..operators.ordered import ranged, rows_before
from ..sources.shared import apart

LINE = "section int, at double, id long, seq int, line string"
ORDER = ["section", "at", "id", "seq"]
#: How long a carrier rests after its note, what lies between two notes on it, and how much the tracks of a note may be off.
REST, APART, OFF = 0.55, 0.001, 1.5


def fixed(c: Column, n: int = 5) -> Column:
    """A number with n decimals."""
    return F.format_string(f"%.{n}f", c + F.lit(0.0))


def write_script(lines: DataFrame, path: str) -> None:
    """Below path: `parts`, text files in order of ORDER, and `index`, a row a part: part, lines, bytes, offset of its first byte in the whole script. Every line ends with a line feed."""
    rows = ranged(lines.select(*ORDER, "line"), ORDER)
    size = F.octet_length("line") + 1
    before = rows_before(rows, size.cast("long")).select("part_", F.col("before_").alias("offset"))
    parts = rows.groupBy("part_").agg(F.count("*").alias("lines"), F.sum(size).cast("long").alias("bytes"))
    parts.join(apart(before), "part_").select(F.col("part_").alias("part"), "lines", "bytes", "offset").write.mode("overwrite").parquet(f"{path}/index")
    rows.select("line").write.mode("overwrite").option("lineSep", "\n").text(f"{path}/parts")  # a file a range, named by its number


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, lines long, bytes long, offset long").parquet(f"{path}/index")


def script_bytes(spark: SparkSession, path: str) -> Iterator[bytes]:
    """The script's parts in order, one at a time."""
    parts = spark.read.format("binaryFile").load(f"{path}/parts").select("path", "content").orderBy("path")
    for r in parts.toLocalIterator():
        yield bytes(r.content)


def carriers(notes: DataFrame) -> DataFrame:
    """notes (video, id, fake, start, end) with carrier, a number from 0 in order of first use, and `opens`, whether the note is its first. Real and fake notes don't share carriers."""
    kept = slots(notes.withColumn("rest", F.col("end") + REST), ["video", "fake"], "start", "rest", "id", APART)
    own = notes.join(apart(kept.select("video", "id", "fake", "slot")), ["video", "id", "fake"])
    first = own.groupBy("video", "fake", "slot").agg(F.min(F.struct("start", "id")).alias("first"))
    numbered = first.withColumn("carrier", F.row_number().over(Window.partitionBy("video").orderBy("first")).cast("long") - 1)  # as many as notes are ever there together
    met = own.join(apart(numbered), ["video", "fake", "slot"])
    return met.withColumn("opens", (F.col("first.start") == F.col("start")) & (F.col("first.id") == F.col("id"))).drop("first", "slot")


def tracks(points: DataFrame, off: float = OFF) -> DataFrame:
    """video, id, t (list), x (list), y (list): the paths (video, id, t, x, y) of notes with as few points as keep them within `off`. A path is one note's."""
    rows = points.groupBy("video", "id").agg(F.array_sort(F.collect_list(F.struct("t", "x", "y"))).alias("p"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for video, i, p in zip(pdf.video, pdf.id, pdf.p):
                t, v = np.array([q["t"] for q in p]), np.array([[q["x"], q["y"]] for q in p])
                k = simplify(t, v, np.array([off, off]))
                out.append((video, i, t[k].tolist(), v[k, 0].tolist(), v[k, 1].tolist()))
            yield pd.DataFrame(out, columns=["video", "id", "t", "x", "y"])

    return rows.mapInPandas(run, "video long, id long, t array<double>, x array<double>, y array<double>")


def chart_lines(notes: DataFrame, points: DataFrame, effects: DataFrame) -> DataFrame:
    """video and LINE's columns of all videos' scripts, without their headers: every note in order of time with its carrier, its track and its envelope, a carrier's declaration before its first note; and effects in order of their
    begin.

    notes: video, id, time, duration, kind, fake. points: video, id, t, x, y, a note's path; a note without a path is shown for .6 s before its time. effects: video, id, kind, start, end, alpha. A fake note is shown, and counts as
    lasting, until its path ends. Times have five decimals and places three."""
    span = points.groupBy("video", "id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    n = notes.join(apart(span), ["video", "id"], "left")
    end = F.col("time") + F.col("duration")
    shown = F.when(F.col("fake") & F.col("t1").isNotNull(), F.greatest(end, F.col("t1") + 1 / 30)).otherwise(end)
    n = n.withColumn("start", F.when(F.col("t0").isNull(), F.greatest(F.lit(0.0), F.col("time") - 0.6)).otherwise(F.least("t0", "time"))).withColumn("end", shown)
    n = n.withColumn("hit", F.when(F.col("fake") & F.col("t1").isNotNull() & (F.col("duration") <= 0), F.col("end")).otherwise(F.col("time")))
    n = carriers(n.select("video", "id", "fake", "kind", "time", "hit", "start", "end"))
    number = lambda c: F.col(c).cast("string")
    key = lambda seq: ["video", F.lit(1).alias("section"), F.col("time").alias("at"), "id", F.lit(seq).alias("seq")]
    carrier = n.where("opens").select(*key(0), F.concat(F.lit("line "), number("carrier")).alias("line"))
    note = n.select(*key(1), F.concat_ws(" ", F.lit("note"), number("carrier"), number("id"), fixed(F.col("hit")), fixed(F.greatest("hit", "end")), "kind", F.when(F.col("fake"), "fake").otherwise("real")).alias("line"))
    edge = F.greatest(F.lit(0.0), F.col("start") - 2e-5)
    keys = [(edge, 0.0), (edge + 1e-5, 1.0), (F.col("end"), 1.0), (F.col("end") + 1e-5, 0.0)]
    envelope = n.select(*key(3), F.concat_ws(" ", F.lit("show"), *(F.concat(fixed(t), F.lit(":"), F.lit(f"{a:g}")) for t, a in keys)).alias("line"))
    spots = F.transform(F.arrays_zip("t", "x", "y"), lambda p: F.concat(fixed(p["t"]), F.lit(":"), fixed(p["x"], 3), F.lit(","), fixed(p["y"], 3)))
    track = tracks(points).join(apart(n.select("video", "id", "time")), ["video", "id"]).select(*key(2), F.concat(F.lit("path "), F.array_join(spots, " ")).alias("line"))
    effect = effects.select("video", F.lit(2).alias("section"), F.col("start").alias("at"), "id", F.lit(0).alias("seq"), F.concat_ws(" ", F.lit("effect"), "kind", number("id"), fixed(F.col("start")), fixed(F.col("end")), fixed(F.col("alpha"), 3)).alias("line"))
    typed = lambda p: p.select("video", F.col("section").cast("int").alias("section"), F.col("at").cast("double").alias("at"), F.col("id").cast("long").alias("id"), F.col("seq").cast("int").alias("seq"), "line")
    out = typed(carrier)
    for part in (note, track, envelope, effect):
        out = out.unionByName(typed(part))
    return out


def chart(video: int, title: str, notes: DataFrame, points: DataFrame, effects: DataFrame) -> DataFrame:
    """Lines of one video's script, with a header."""
    mine = [df.where(F.col("video") == video) for df in (notes, points, effects)]
    head = notes.sparkSession.createDataFrame([(0, 0.0, 0, k, x) for k, x in enumerate(("# reconstruction from video", f"title {title}", "timing 0 60 4"))], LINE)
    return head.unionByName(chart_lines(*mine).drop("video"))
