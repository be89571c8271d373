"""Segments of lines from votes."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import apart, held
from .parts import labels


def segments(points: DataFrame, peaks: DataFrame, angles: int, gap: float, least: float, near: int = 1, close: int = 2) -> DataFrame:
    """th, rho, u0, u1, n: segments of the lines that won votes. Points (px, py) within `near` of a line of the peaks (th, rho, n) are projected on it; a gap of more than `gap` ends a run, and runs as long as `least`
    stay. Lines that differ by one angle and up to `close` in rho, and those that such lines lead to, are one: their segments go to the line with the most votes, and those that overlap there become one.

    A point meets a peak by equality of angle and rho; angles are those of the peaks, `angles` at most."""
    step = math.pi / angles
    peaks = held(peaks.select("th", "rho", "n"))
    few = F.broadcast(peaks.select("th").distinct())  # `angles` rows at most
    at = lambda c, s: F.col("px") * c(F.col("th") * 2 * (step / 2)) + F.col("py") * s(F.col("th") * 2 * (step / 2))
    here = points.select("px", "py").crossJoin(few).withColumn("off", F.rint(F.round(at(F.cos, F.sin), 6)).cast("long"))
    here = here.withColumn("rho", F.explode(F.array(*(F.col("off") + k for k in range(-near, near + 1)))))
    hits = here.join(apart(peaks.select("th", "rho")), ["th", "rho"]).withColumn("u", F.round(-F.col("px") * F.sin(F.col("th") * 2 * (step / 2)) + F.col("py") * F.cos(F.col("th") * 2 * (step / 2)), 6))
    w = Window.partitionBy("th", "rho").orderBy("u", "px", "py")
    cut = F.when(F.col("u") - F.lag("u").over(w) > gap, 1).otherwise(0)
    runs = hits.withColumn("new", cut).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    long = runs.groupBy("th", "rho", "run").agg(F.min("u").alias("u0"), F.max("u").alias("u1"), F.count("*").alias("n")).where(F.col("u1") - F.col("u0") >= least)
    # lines that are the same
    line = F.struct("th", "rho")
    reach = F.explode(F.array(*(F.struct((F.col("th") + i).alias("th"), (F.col("rho") + j).alias("rho")) for i in (-1, 0, 1) for j in range(-close, close + 1) if i or j)))
    edges = peaks.select(F.lit(0).alias("k"), line.alias("a"), reach.alias("b")).join(apart(peaks.select(line.alias("b"))), "b").select("k", "a", "b")
    same = labels(edges, ["k"]).select("node", "part")
    named = peaks.withColumn("node", line).join(apart(same), "node", "left").withColumn("part", F.coalesce("part", "node"))
    best = named.groupBy("part").agg(F.max(F.struct("n", (-F.col("th")).alias("a"), (-F.col("rho")).alias("b"))).alias("m")).select("part", (-F.col("m.a")).alias("th"), (-F.col("m.b")).alias("rho"))
    own = named.select(F.col("th").alias("t"), F.col("rho").alias("r"), "part").join(apart(best), "part")
    moved = apart(long.withColumnsRenamed({"th": "t", "rho": "r"})).join(apart(own), ["t", "r"])
    v = Window.partitionBy("th", "rho").orderBy("u0", "u1", "t", "r")
    apart_ = F.col("u0") > F.max("u1").over(v.rowsBetween(Window.unboundedPreceding, -1))
    merged = moved.withColumn("new", F.coalesce(apart_, F.lit(True)).cast("int")).withColumn("seg", F.sum("new").over(v.rowsBetween(Window.unboundedPreceding, 0)))
    return merged.groupBy("th", "rho", "seg").agg(F.min("u0").alias("u0"), F.max("u1").alias("u1"), F.max("n").alias("n")).drop("seg")
