"""Operators on measured paths (arrays of points or ordered rows), on whole sets and on line votes."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import median_filter, ranged, rows_before, unwrap


def extended(df: DataFrame, path: str, hit: Column, least: float, low: float, high: float, speed: float, below: float, margin: float, most: float) -> DataFrame:
    """`start`: where a measured fall begins, carried on backwards to `margin` above the top if it has three points, leads by clip(3 steps, low, high)
    before the hit, moves down faster than `speed` and starts above `below`; the first point otherwise."""
    a, b = F.col(path)[0], F.element_at(path, F.least(F.lit(4), F.size(path)))
    head = F.slice(path, 1, 5)
    steps = F.array_sort(F.filter(F.transform(F.slice(path, 2, 4), lambda q, i: q["t"] - F.element_at(head, (i + 1).cast("int"))["t"]), lambda z: z > 1e-4))
    n = F.size(steps)
    step = F.when(n == 0, F.lit(None)).when(n % 2 == 1, F.try_element_at(steps, (n / 2).cast("int") + 1)).otherwise((F.try_element_at(steps, (n / 2).cast("int")) + F.try_element_at(steps, (n / 2).cast("int") + 1)) / 2)
    dt = b["t"] - a["t"]
    vx, vy = ((b[c] - a[c]) / F.nullif(dt, F.lit(0.0)) for c in "xy")
    extra = F.least(F.least(F.lit(most), (a["y"] + margin) / vy), a["t"])
    ok = (F.size(path) >= 3) & (dt > least) & (hit - a["t"] >= F.greatest(F.lit(low), F.least(F.lit(high), 3 * step))) & (vy > speed) & (a["y"] < below)
    moved = F.struct((a["t"] - extra).alias("t"), (a["x"] - vx * extra).alias("x"), (a["y"] - vy * extra).alias("y"))
    return df.withColumn("start", F.when(ok, moved).otherwise(a))


def envelope(df: DataFrame, first: Column, full: Column, last: Column, edge: float = 1e-5) -> DataFrame:
    """Five key frames (place, at, alpha) of each row: unseen, appearing, seen, leaving, unseen."""
    at = [first - edge, first, full, last, last + edge]
    keys = F.array(*(F.struct(F.lit(k).alias("place"), t.alias("at"), F.lit(a).alias("alpha")) for k, (t, a) in enumerate(zip(at, (0.0, 0.5, 1.0, 0.5, 0.0)))))
    return df.select("*", F.explode(keys).alias("key_")).select("*", "key_.*").drop("key_")


def axis_angles(df: DataFrame, keys: list[str], order: list[str], degrees: str, snap: float = 0.4, upright: float = 90.0) -> DataFrame:
    """`angle`: unwrapped, with a median over three rows, upright where within `snap` of it."""
    u = median_filter(unwrap(df, keys, order, degrees), keys, order, "unwrapped")
    return u.withColumn("angle", F.when(F.abs(F.col("filtered") - upright) < snap, upright).otherwise(F.col("filtered"))).drop("unwrapped", "filtered")


def extend_ends(own: DataFrame, other: DataFrame, key: str, t: str) -> DataFrame:
    """Points of `own`, and those of `other` that lie before or after all of them; `own` says which."""
    span = own.groupBy(key).agg(F.min(t).alias("lo_"), F.max(t).alias("hi_"))
    ends = other.join(span, key).where((F.col(t) < F.col("lo_")) | (F.col(t) > F.col("hi_"))).drop("lo_", "hi_")
    return own.withColumn("own", F.lit(True)).unionByName(ends.withColumn("own", F.lit(False)))


def two_predictors(df: DataFrame, key: str, value: str, first: Column, second: Column, unit: float = 1.0) -> DataFrame:
    """b1, b2: least squares of value by first and second / unit with an intercept, by sums of products around the means. Two passes over
    pre-aggregated sums: no key's rows meet in one place."""
    m = df.groupBy(key).agg(*(F.avg(c).alias(n) for n, c in (("mz_", F.col(value)), ("ma_", first), ("mb_", second))))
    c = df.join(m, key).select(key, (F.col(value) - F.col("mz_")).alias("z"), (first - F.col("ma_")).alias("a"), ((second - F.col("mb_")) / unit).alias("b"))
    s = c.groupBy(key).agg(*(F.sum(F.col(x[0]) * F.col(x[1])).alias(x) for x in ("aa", "bb", "ab", "az", "bz")))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    return s.where(det > 1e-6).select(key, ((F.col("az") * F.col("bb") - F.col("bz") * F.col("ab")) / det).alias("b1"), ((F.col("bz") * F.col("aa") - F.col("az") * F.col("ab")) / det).alias("b2"))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """`place` of every row in a total order, from 1. Rows are sorted by ranges, once, and a range's rows follow those of the ranges before it: no task sorts all."""
    rows = ranged(df, order)
    return rows.join(F.broadcast(rows_before(rows, F.lit(1))), "part_").withColumn("place", F.col("in_") + F.col("before_")).drop("part_", "in_", "before_", "all_")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many rows of a are missing in b and how many of b are not in a, with multiplicity; 0 and 0 where both are equal."""
    n = a.withColumn("n_", F.lit(1)).unionByName(b.withColumn("n_", F.lit(-1))).groupBy(*a.columns).agg(F.sum("n_").alias("n_"))
    return n.agg(F.coalesce(F.sum(F.greatest("n_", F.lit(0))), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.greatest(-F.col("n_"), F.lit(0))), F.lit(0)).alias("added"))


def hough(points: DataFrame, angles: int, least: int) -> DataFrame:
    """Line votes (th, rho, n) of points (px, py) above `least` that no neighbouring line exceeds. Votes are summed before any exchange; only sums
    above `least` are compared."""
    step = math.pi / angles
    a = F.explode(F.transform(F.sequence(F.lit(0), F.lit(angles - 1)), lambda k: F.struct(k.alias("th"), F.rint(F.round(F.col("px") * F.cos(k * 2 * (step / 2)) + F.col("py") * F.sin(k * 2 * (step / 2)), 6)).cast("long").alias("rho"))))
    h = points.select(a.alias("v")).groupBy("v.th", "v.rho").agg(F.count("*").alias("n")).where(F.col("n") > least)
    around = F.explode(F.array(*(F.struct((F.col("th") + i).alias("th"), (F.col("rho") + j).alias("rho")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    top = h.select("n", around.alias("v")).groupBy("v.th", "v.rho").agg(F.max("n").alias("top"))
    return h.join(top, ["th", "rho"]).where("n = top").select(F.col("th").cast("long").alias("th"), "rho", "n")


def velocities(df: DataFrame, keys: list[str], order: list[str], t: str, value: str, unit: float = 1.0) -> DataFrame:
    """`v`: change of the value to the row before, for `unit` seconds; null for the first row and between equal times."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("v", (F.col(value) - F.lag(value).over(w)) / F.nullif((F.col(t) - F.lag(t).over(w)) / unit, F.lit(0.0)))


def counts_until(atoms: DataFrame, probes: DataFrame, key: str, t: str) -> DataFrame:
    """Probes with `combo`, how many atoms of their key have a time up to theirs: one union and one running count, no range join."""
    rows = atoms.select(key, F.col(t).alias("t_"), F.lit(1).alias("n_"), F.lit(None).cast(probes.select(F.struct("*").alias("p")).schema["p"].dataType).alias("p_"))
    rows = rows.unionByName(probes.select(key, F.col(t).alias("t_"), F.lit(0).alias("n_"), F.struct("*").alias("p_")))
    w = Window.partitionBy(key).orderBy("t_").rangeBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("combo", F.sum("n_").over(w)).where("p_ IS NOT NULL").select("p_.*", "combo")


def script(lines: DataFrame, keys: list[str], order: list[str], line: str) -> DataFrame:
    """notes, script, size: the lines of each key in order, as one text, and its size with line ends. A script is one value, so a key is as large as what it exports."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(line).alias("line_"))))
    return lines.groupBy(*keys).agg(F.count("*").alias("notes"), F.array_join(F.transform(rows, lambda x: x["line_"]), "\n").alias("script"), F.sum(F.length(line) + 1).alias("size"))


#: How far a line may be from an axis; lines of a family, its deviation and its common tilt, for a close and for a large family; the pivot's distance.
FAMILY = {"near": 1.5, "close": (6, 0.12, 0.18), "large": (12, 0.45, 0.30), "least": 0.005, "arm": 3450.0}


def aligned_families(lines: DataFrame, key: list[str], near: float = FAMILY["near"], close: tuple = FAMILY["close"], large: tuple = FAMILY["large"], least: float = FAMILY["least"], arm: float = FAMILY["arm"]) -> DataFrame:
    """Lines (key, rotation, x, y, anchored, ...) with the rotation of their axis where a family of lines of one key is parallel to it: enough lines within `near` of level or upright, with a small median deviation around a small common
    tilt. A line that hangs on no target turns around the pivot `arm` from its place, so its place moves; `moved` says which did. Families are measured by two grouped medians."""
    tilt = lambda axis: F.pmod(F.col("rotation") - axis + 90, F.lit(180.0)) - 90
    row = lines.withColumn("axis_", F.when(F.abs(tilt(0)) < near, 0).when(F.abs(tilt(90)) < near, 90)).withColumn("tilt_", F.when(F.col("axis_") == 0, tilt(0)).otherwise(tilt(90)))
    family = row.where("axis_ IS NOT NULL")
    m = family.groupBy(*key, "axis_").agg(F.count("*").alias("n_"), F.percentile("tilt_", F.lit(0.5)).alias("m_"))
    d = family.join(m, [*key, "axis_"]).groupBy(*key, "axis_", "n_", "m_").agg(F.percentile(F.abs(F.col("tilt_") - F.col("m_")), F.lit(0.5)).alias("d_"))
    fits = lambda b: (F.col("n_") >= b[0]) & (F.col("d_") <= b[1]) & (F.abs("m_") <= b[2])
    ok = d.where(fits(close) | fits(large)).select(*key, "axis_", F.lit(True).alias("ok_"))
    r = row.join(ok, [*key, "axis_"], "left").withColumn("moved", F.coalesce("ok_", F.lit(False)) & (F.abs("tilt_") >= least))
    a, b = F.radians(-F.col("rotation")), F.radians(F.col("tilt_") - F.col("rotation"))
    turn = F.col("moved") & ~F.col("anchored")
    out = r.withColumn("x", F.col("x") + F.when(turn, (F.cos(a) - F.cos(b)) * arm).otherwise(0.0)).withColumn("y", F.col("y") - F.when(turn, (F.sin(a) - F.sin(b)) * arm).otherwise(0.0))
    return out.withColumn("rotation", F.when(F.col("moved"), F.col("rotation") - F.col("tilt_")).otherwise(F.col("rotation"))).drop("axis_", "tilt_", "ok_")
