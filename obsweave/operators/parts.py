"""Connected parts of masks as tables: runs of pixels in a row of a frame, joined to the runs that they touch in the row above, with labels spread by rounds. A frame's pixels are only together while its runs are read off."""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import apart, held
from .pixels import opened

RUN = "video long, frame long, y long, x0 long, x1 long, spread double"  # x1: after the last pixel; spread: sum of the greatest less the least channel
CELL = 64  # pixels of a row in which runs are looked for together


def runs(frames: DataFrame, mask: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Rows of RUN of a mask of each frame (video, frame, height, width, pixels as RGB bytes); none for a frame without pixels or of a wrong size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for video, frame, h, w, data in zip(*(b.column(k).to_pylist() for k in range(5))):
                if data is None or not h or not w or len(data) != 3 * h * w:
                    continue
                im = np.frombuffer(data, np.uint8).reshape(h, w, 3)
                step = np.diff(np.pad(mask(im), ((0, 0), (1, 1))).astype(np.int8), axis=1)
                (y, x0), x1 = np.nonzero(step == 1), np.nonzero(step == -1)[1]
                spread = np.pad(np.cumsum(im.max(2).astype(np.int64) - im.min(2), axis=1), ((0, 0), (1, 0)))
                n = len(y)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, video)), pa.array(np.full(n, frame)), pa.array(y), pa.array(x0), pa.array(x1), pa.array((spread[y, x1] - spread[y, x0]).astype(float))], [c.split()[0] for c in RUN.split(", ")])

    return frames.select("video", "frame", "height", "width", "pixels").mapInArrow(run, RUN)


def runs_of_points(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, y, x0, x1: runs of a table of pixels."""
    p = points.select(*keys, F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y")).distinct()
    k = F.col("x") - F.row_number().over(Window.partitionBy(*keys, "y").orderBy("x"))
    return p.withColumn("k", k).groupBy(*keys, "y", "k").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).drop("k")


def touching(rows: DataFrame, keys: list[str], cell: int = CELL) -> DataFrame:
    """keys, a, b: runs (y, x0) that share a side with a run in the row above, by equality of row and cell."""
    name = F.struct("y", "x0")
    cells = F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor((F.col("x1") - 1) / cell))).alias("cell")
    own = rows.select(*keys, "y", "x0", "x1", name.alias("a"), cells)
    up = apart(rows.select(*keys, (F.col("y") + 1).alias("y"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), name.alias("b"), cells))
    return own.join(up, [*keys, "y", "cell"]).where("x0 < u1 AND u0 < x1").select(*keys, "a", "b").distinct()


def labels(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, part: the least node that each node of the edges (keys, a, b) is connected with. Every round points nodes, and the nodes that point at them, at the least one in reach, so the rounds grow with the
    logarithm of a part's length; no part is in one task."""
    both = held(edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = held(both.groupBy(*keys, F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("part")))
    while True:
        at = apart(now.select(*keys, F.col("node").alias("b"), F.col("part").alias("seen")))
        near = both.join(at, [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        step = now.join(apart(near), [*keys, "node"]).select(*keys, "node", "part", F.least("part", "seen").alias("low"))
        # the old part's name is a node too: it learns of the lower name, and whoever points at it
        told = step.where("low < part").groupBy(*keys, F.col("part").alias("node")).agg(F.min("low").alias("told"))
        new = step.join(apart(told), [*keys, "node"], "left").select(*keys, "node", F.col("part").alias("was"), F.least("low", F.coalesce("told", "low")).alias("part"))
        jump = apart(new.select(*keys, F.col("node").alias("part"), F.col("part").alias("further")))
        nxt = held(new.join(jump, [*keys, "part"], "left").select(*keys, "node", "was", F.least("part", F.coalesce("further", "part")).alias("part")))
        if nxt.where("part < was").isEmpty():
            return nxt.drop("was")
        now = nxt.drop("was")


def parts(rows: DataFrame, keys: list[str], *sums: str) -> DataFrame:
    """keys, part (y and x0 of its first run), left, right, top, bottom (last pixels), area and sums of further columns of each connected part; neighbours share a side."""
    name = F.struct("y", "x0")
    mine = rows.withColumn("node", name).join(apart(labels(touching(rows, keys), keys)), [*keys, "node"], "left").withColumn("part", F.coalesce("part", "node"))
    return mine.groupBy(*keys, "part").agg(F.min("x0").alias("left"), (F.max("x1") - 1).alias("right"), F.min("y").alias("top"), F.max("y").alias("bottom"), F.sum(F.col("x1") - F.col("x0")).alias("area"), *(F.sum(c).alias(c) for c in sums))


def boxes(p: DataFrame) -> DataFrame:
    """With width, height, fill and the mean spread."""
    p = p.withColumn("width", F.col("right") - F.col("left") + 1).withColumn("height", F.col("bottom") - F.col("top") + 1)
    return p.withColumn("fill", F.col("area") / (F.col("width") * F.col("height"))).withColumn("ratio", F.col("width") / F.col("height")).withColumn("grey", F.col("spread") / F.col("area"))


#: Masks and bounds of outlines of targets and of notes, in pixels of a 640 x 360 frame.
TARGET = {"least": 175, "grey": 20, "top": 50, "bottom": 335, "size": (18, 28), "ratio": (0.9, 1.12), "fill": (0.12, 0.55)}
NOTE = {"least": (160, 160, 175), "width": (10, 28), "height": (10, 300), "area": 40, "tall": 35, "hold": 25, "ratio": (0.45, 1.7), "full": 0.60}


def between(c: str, bounds: tuple[float, float]) -> Column:
    """Strictly between."""
    return (F.col(c) > bounds[0]) & (F.col(c) < bounds[1])


def white_outlines(frames: DataFrame) -> DataFrame:
    """video, frame, kind, x, y, width, height, value (fill) of thin grey-white outlines of round targets."""

    def mask(im: np.ndarray) -> np.ndarray:
        rows = np.arange(len(im))[:, None]
        return (im.min(2) > TARGET["least"]) & (np.ptp(im, axis=2) < TARGET["grey"]) & (rows >= TARGET["top"]) & (rows < TARGET["bottom"])

    b = boxes(parts(runs(frames, mask), ["video", "frame"], "spread"))
    ok = F.col("width").between(*TARGET["size"]) & F.col("height").between(*TARGET["size"]) & between("ratio", TARGET["ratio"]) & between("fill", TARGET["fill"])
    return detections(b.where(ok), F.lit("target"), (F.col("top") + F.col("bottom")) / 2)


def notes(frames: DataFrame) -> DataFrame:
    """video, frame, kind, x, y, width, height, value (fill) of bright notes: held ones, with the head at the lower end, are tall; drops have a lower fill than taps; white outlines are neither."""
    low = np.array(NOTE["least"], np.uint8)
    b = boxes(parts(runs(frames, lambda im: opened((im > low).all(2))), ["video", "frame"], "spread"))
    tall = F.col("height") > NOTE["tall"]
    size = F.col("width").between(*NOTE["width"]) & F.col("height").between(*NOTE["height"]) & (F.col("area") >= NOTE["area"])
    shape = F.when(tall, F.col("width") <= NOTE["hold"]).otherwise((F.col("height") == NOTE["tall"]) | between("ratio", NOTE["ratio"]))
    outline = ~tall & between("ratio", (0.90, TARGET["ratio"][1])) & between("fill", (TARGET["fill"][0], NOTE["full"])) & (F.col("grey") < TARGET["grey"])
    kind = F.when(tall, "hold").when(F.col("fill") > NOTE["full"], "tap").otherwise("drop")
    middle = (F.col("top") + F.col("bottom")) / 2
    return detections(b.where(size & shape & ~outline), kind, F.when(tall, F.col("bottom") - F.col("width") / 2).otherwise(middle))


def detections(b: DataFrame, kind: Column, y: Column) -> DataFrame:
    return b.select("video", "frame", kind.alias("kind"), ((F.col("left") + F.col("right")) / 2).alias("x"), y.alias("y"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.col("fill").alias("value"))


def ring_votes(points: DataFrame, keys: list[str], radius: float, share: float = 0.69, angles: int = 32) -> DataFrame:
    """keys, x, y, votes: centres of rings of a radius. Every pixel (px, py) votes for the places that lie `radius` from it at `angles` angles, once each; votes are added up before any exchange, and a centre stays if it has
    `share` of the angles and no neighbour, nor any place within half the radius, has more."""
    turn = [2 * math.pi * k / angles for k in range(angles)]
    to = F.array_distinct(F.array(*(F.struct(F.rint(F.col("px") + radius * math.cos(a)).cast("long").alias("x"), F.rint(F.col("py") + radius * math.sin(a)).cast("long").alias("y")) for a in turn)))
    votes = points.select(*keys, F.explode(to).alias("c")).groupBy(*keys, "c.x", "c.y").agg(F.count("*").alias("votes")).where(F.col("votes") >= share * angles)
    cell = max(1, int(radius / 2))
    at = [F.floor(F.col(c) / cell).alias(f"c{c}") for c in "xy"]
    best = F.struct("votes", (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))
    tops = votes.select(*keys, *at, best.alias("best")).groupBy(*keys, "cx", "cy").agg(F.max("best").alias("best"))  # a row a cell
    near = tops
    for c in ("cx", "cy"):
        near = near.withColumn(c, F.explode(F.array(*(F.col(c) + d for d in (-1, 0, 1)))))
    near = near.groupBy(*keys, "cx", "cy").agg(F.max("best").alias("top"))
    return votes.select("*", *at, best.alias("best")).join(apart(near), [*keys, "cx", "cy"]).where("best = top").select(*keys, "x", "y", "votes")
