"""Operators on the motion of tracked things: contacts, supports, decelerations, caps, tails and anchors."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import apart, held
from .joins import argmin_per, band_join
from .ordered import by


def trailing_velocity(df: DataFrame, keys: list[str], order: list[str], t: str, values: list[str], rows: int = 5) -> DataFrame:
    """v_<value>: velocity from the first to the last of the trailing `rows` rows (null for the first); bend_: how far the middle of them lies from that line."""
    w = by(keys, order).rowsBetween(1 - rows, 0)
    dt = F.col(t) - F.first(t).over(w)
    out = df
    for c in values:
        v = (F.col(c) - F.first(c).over(w)) / F.nullif(dt, F.lit(0.0))
        # whole windows as arrays of at most `rows` points
        pts = F.collect_list(F.struct(F.col(t).alias("t"), F.col(c).alias("v"))).over(w)
        out = out.withColumn(f"v_{c}", v).withColumn(f"pts_{c}", pts)
        first = F.col(f"pts_{c}")[0]
        bend = F.array_max(F.transform(f"pts_{c}", lambda p: F.abs(first["v"] + F.col(f"v_{c}") * (p["t"] - first["t"]) - p["v"])))  # noqa: B023
        out = out.withColumn(f"bend_{c}", bend).drop(f"pts_{c}")
    return out


def window_support(events: DataFrame, rings: DataFrame, keys: list[str], t: str, value: str, near: Column, before: float, after: float, share: float = 0.95) -> DataFrame:
    """Events with `support` = max(0, best ring in [t, t + after] - share * best ring in [t - before, t)); `near` compares y and y_r and the like. An
    event without rings has support 0."""
    pairs = band_join(events, rings, keys, t, -before, after).where(near)
    late = F.col(f"{t}_r") >= F.col(t)
    best = lambda c: F.coalesce(F.max(F.when(c, F.col(f"{value}_r"))), F.lit(0.0))
    names = [*keys, "id"]
    got = pairs.groupBy(*names).agg(F.greatest(F.lit(0.0), best(late) - share * best(~late)).alias("support"))
    return events.join(got, names, "left").withColumn("support", F.coalesce("support", F.lit(0.0)))


def local_energy(events: DataFrame, sources: DataFrame, keys: list[str], t: str, place: str, power: str, offsets: dict[str, list[float]], reach: float, sigma: float, share: float = 0.65) -> DataFrame:
    """`support` = max(0, energy after - share * energy before); energy at an offset: the largest power * exp(-d**2 / (2 sigma**2)) within `reach`."""
    every = [*offsets["before"], *offsets["after"]]
    pairs = band_join(events, sources, keys, t, min(every) - reach, max(every) + reach)
    d = F.col(f"{place}_r") - F.col(place)
    pairs = pairs.withColumn("e_", F.col(f"{power}_r") * F.exp(-d * d / (2 * sigma * sigma)))
    dt = F.col(f"{t}_r") - F.col(t)
    at = lambda side: F.coalesce(F.max(F.when(F.array_max(F.array(*(F.abs(dt - o) < reach for o in offsets[side]))), F.col("e_"))), F.lit(0.0))
    got = pairs.groupBy(*keys, "id").agg(F.greatest(F.lit(0.0), at("after") - share * at("before")).alias("support"))
    return events.join(got, [*keys, "id"], "left").withColumn("support", F.coalesce("support", F.lit(0.0)))


def deceleration(df: DataFrame, keys: list[str], order: list[str], speed: str, slow: float, fast: float, settled: float | None = None) -> DataFrame:
    """The first row of each key that is slow after fast ones: abs(speed) < slow while the median of up to three rows before exceeds `fast` and, with
    `settled`, the median of this and the next two stays below it."""
    w = by(keys, order)
    prior = F.percentile(speed, F.lit(0.5)).over(w.rowsBetween(-3, -1))
    ok = (F.abs(speed) < slow) & (prior > fast)
    if settled is not None:
        ok = ok & (F.abs(F.percentile(speed, F.lit(0.5)).over(w.rowsBetween(0, 2))) < settled)
    hit = df.withColumn("prior_", prior).withColumn("ok_", ok).where("ok_").withColumn("k_", F.row_number().over(w))
    return hit.where("k_ = 1").withColumnRenamed("prior_", "prior").drop("ok_", "k_")


def stable_ends(df: DataFrame, keys: list[str], order: list[str], dx: str, dy: str) -> DataFrame:
    """`swapped`: whether head and tail change places so that each axis points as the corrected one before it. Turning a row changes the sign of
    two products, so the running parity of negative products of raw neighbours is the whole answer."""
    w = by(keys, order)
    against = F.col(dx) * F.lag(dx).over(w) + F.col(dy) * F.lag(dy).over(w) < 0
    return df.withColumn("swapped", F.sum(F.when(against, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1)


def smooth(df: DataFrame, keys: list[str], order: list[str], value: str, share: float = 0.6) -> DataFrame:
    """Exponential mean, `share` for the new value: an ordered fold."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("v_")))).alias("rows_"))
    last = lambda acc: F.try_element_at(acc, F.lit(-1))["s_"]
    zero = F.transform(F.slice("rows_", 1, 0), lambda r: F.struct(*(r[c].alias(c) for c in order), r["v_"].cast("double").alias("s_")))
    out = F.aggregate("rows_", zero, lambda acc, r: F.concat(acc, F.array(F.struct(*(r[c].alias(c) for c in order), F.when(F.size(acc) == 0, r["v_"].cast("double")).otherwise(share * r["v_"] + (1 - share) * last(acc)).alias("s_")))))
    return rows.select(*keys, F.explode(out).alias("r")).select(*keys, "r.*").withColumnRenamed("s_", "smoothed")


def tail_collapse(df: DataFrame, keys: list[str], t: str, tie: str, length: str, last: float, low: float, high: float, most: float) -> DataFrame:
    """finish: when a shrinking length reaches 0, from the median rate over the final `last` seconds if at least three rows and a rate in (low, high), at
    most `most` seconds after the last row."""
    w = by(keys, [t, tie])
    end = F.max(t).over(Window.partitionBy(*keys))
    rate = -(F.col(length) - F.lag(length).over(w)) / F.nullif(F.col(t) - F.lag(t).over(w), F.lit(0.0))
    near = df.withColumn("end_", end).withColumn("rate_", rate).where(F.col(t) >= F.col("end_") - last)
    got = near.groupBy(*keys).agg(F.percentile("rate_", F.lit(0.5)).alias("rate"), F.count("*").alias("n"), F.first("end_").alias("end"), F.max_by(length, F.struct(t, tie)).alias("left"))
    return got.where((F.col("n") >= 3) & (F.col("rate") > low) & (F.col("rate") < high)).withColumn("finish", F.col("end") + F.least(F.lit(most), F.col("left") / F.col("rate")))


def crossing(df: DataFrame, keys: list[str], t: str, tie: str, value: str, level: float) -> DataFrame:
    """contact: the first time a path rises through `level`, linear within its step."""
    w = by(keys, [t, tie])
    s = df.withColumn("t1", F.lead(t).over(w)).withColumn("v1", F.lead(value).over(w))
    s = s.where((F.col("t1") > F.col(t)) & (F.col(value) <= level) & (F.col("v1") >= level))
    at = F.col(t) + (level - F.col(value)) * (F.col("t1") - F.col(t)) / F.greatest(F.lit(1e-6), F.col("v1") - F.col(value))
    return s.groupBy(*keys).agg(F.min(at).alias("contact"))


def attach(events: DataFrame, targets: DataFrame, keys: list[str], t: str, low: float, high: float, near: Column, cost: Column, *ties: str) -> DataFrame:
    """Every event with the cheapest target in time and place; events without one go."""
    return argmin_per(band_join(events, targets, keys, t, low, high).where(near), [*keys, "id"], cost, *ties)


def without(events: DataFrame, others: DataFrame, keys: list[str], t: str, low: float, high: float, near: Column) -> DataFrame:
    """Events without any of `others` in time and place."""
    hit = band_join(events, others, keys, t, low, high).where(near).select(*keys, "id").distinct()
    return events.join(hit, [*keys, "id"], "left_anti")


def split_pairs(df: DataFrame, first: list[Column], second: list[Column], names: list[str], split: Column) -> DataFrame:
    """Rows for which `split` holds become two, of the columns `first` and `second`; others stay as `first`."""
    one, two = (F.struct(*(c.alias(n) for c, n in zip(cs, names))) for cs in (first, second))
    return df.select("*", F.explode(F.when(split, F.array(one, two)).otherwise(F.array(one))).alias("part_")).select("*", *(F.col(f"part_.{n}") for n in names)).drop("part_")


def once_each(pairs: DataFrame, keys: list[str], a: str, b: str, order: list[str]) -> DataFrame:
    """One-to-one pairs: in `order`, a pair stands if neither of its ends has been used."""
    rows = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in (a, b) if c not in order)))).alias("rows_"))
    used = lambda acc, r: F.exists(acc, lambda q: (q[a] == r[a]) | (q[b] == r[b]) | (q[a] == r[b]) | (q[b] == r[a]))
    kept = F.aggregate("rows_", F.slice("rows_", 1, 0), lambda acc, r: F.when(used(acc, r), acc).otherwise(F.concat(acc, F.array(r))))
    return rows.select(*keys, F.explode(kept).alias("r")).select(*keys, "r.*")


def unrepresented(rows: DataFrame, least: int, median: float, close: float, share: float, block: int = 256) -> DataFrame:
    """kind, track: the tracks that no other track of their kind represents, that is one with `least` frames in common, a median distance below `median` there and a share of `share` closer than `close`.

    A track needs one such partner, so partners come in rounds, some `block` of a kind at first and twice as many each time, and a track leaves once one is found. Whoever has none meets them all.
    rows: kind, track, frame, y (an integer), one row a kind, track and frame."""
    rows = held(rows)
    tracks = rows.groupBy("kind", "track").agg(F.count("frame").alias("n"))
    able = apart(rows.where("frame IS NOT NULL").join(apart(tracks.where(F.col("n") >= least).select("kind", "track")), ["kind", "track"], "left_semi"))
    partners = able.select("kind", F.col("track").alias("b"), "frame", F.col("y").alias("y_r"), F.xxhash64("track").alias("deal"))
    most = tracks.groupBy("kind").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    parts = max(1, -(-most // block))
    gap, n, g = F.abs(F.col("y") - F.col("y_r")), F.col("n"), F.col("known")
    # the median lies below if more than half of the distances do, or half of them and the two in the middle on average
    half = (F.col("below") * 2 > g) | ((F.col("below") * 2 == g) & (F.col("low") + F.col("high") < 2 * median))
    fits = (n >= least) & half & (F.col("near").cast("double") / n >= share)
    left, done = held(able), 0
    while done < parts:
        until = min(parts, max(1, 2 * done))
        deal = partners.where(F.pmod("deal", F.lit(parts)).between(done, until - 1)).drop("deal")
        met = left.join(apart(deal), ["kind", "frame"]).where("track <> b").groupBy("kind", "track", "b")
        met = met.agg(F.count("*").alias("n"), F.count(gap).alias("known"), F.count_if(gap < median).alias("below"), F.count_if(gap < close).alias("near"), F.max(F.when(gap < median, gap)).alias("low"), F.min(F.when(gap >= median, gap)).alias("high"))
        found = met.where(fits).select("kind", "track").distinct()
        left, done = held(left.join(apart(found), ["kind", "track"], "left_anti")), until
        if left.isEmpty():
            break
    there = able.select("kind", "track").distinct().join(apart(left.select("kind", "track").distinct()), ["kind", "track"], "left_anti")
    return tracks.select("kind", "track").join(apart(there), ["kind", "track"], "left_anti")
