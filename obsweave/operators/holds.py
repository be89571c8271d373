"""Holds and sprites with measured paths, as tables of points: rotations and anchors that measurements contradict, and sprites that are there twice."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import apart, held
from .joins import as_of
from .ordered import interpolate, islands
from .paths import axis_angles

#: Samples further apart in time are not in a row; how many in a row count.
ROW, IN_A_ROW = 0.05, 3


def in_a_row(rows: DataFrame, key: str, bad: Column, gap: float = ROW) -> DataFrame:
    """key, longest: the longest run of rows in order of t for which `bad` holds, none more than `gap` after the one before."""
    w = Window.partitionBy(key).orderBy("t")
    r = rows.withColumn("bad_", bad)
    runs = islands(r, [key], ["t"], (F.col("bad_") != F.lag("bad_").over(w)) | (F.col("t") - F.lag("t").over(w) > gap), "run_").where("bad_")
    return runs.groupBy(key, "run_").agg(F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("longest"))


def repaired_rotations(caps: DataFrame, given: DataFrame, key: str = "hold", height: float = 720.0, margin: float = 0.22, off: float = 8.0, gap: float = ROW) -> DataFrame:
    """key, t, degrees, repaired: the rotations `given` (key, t, degrees), with the angles of a hold's caps (key, t, hx, hy, tx, ty) in place of theirs where the caps contradict them by more than `off` degrees in three
    samples in a row. Caps count where both are near the picture and 80 to 800 pixels apart; a hold needs four. An axis has no direction, so half a turn is no difference."""
    length, edge = F.hypot(F.col("tx") - F.col("hx"), F.col("ty") - F.col("hy")), height * margin
    near = F.col("hy").between(-edge, height + edge) & F.col("ty").between(-edge, height + edge)
    seen = caps.where(near & length.between(80, 800)).withColumn("deg", F.degrees(F.atan2(F.col("hy") - F.col("ty"), F.col("tx") - F.col("hx"))))
    angles = axis_angles(seen, [key], ["t"], "deg").select(key, "t", "angle")
    told = interpolate(given.select(key, "t", F.col("degrees").alias("x")), angles, key)
    apart_by = F.abs(F.pmod(F.col("angle") - F.col("interpolated") + 90, F.lit(180.0)) - 90)
    wrong = in_a_row(told, key, F.coalesce(apart_by > off, F.lit(False)), gap).where(F.col("longest") >= IN_A_ROW)
    enough = angles.groupBy(key).agg(F.count("*").alias("n")).where("n >= 4")
    holds = apart(wrong.join(apart(enough), key).select(key, F.lit(True).alias("repaired")))
    own = given.join(holds, key, "left").withColumn("repaired", F.coalesce("repaired", F.lit(False))).select(key, "t", "degrees", "repaired")
    new = apart(angles.join(holds, key).select(key, "t", F.col("angle").alias("degrees"), "repaired"))
    return own.join(new.select(key, "t"), [key, "t"], "left_anti").unionByName(new)


def without_strays(points: DataFrame, seen: DataFrame) -> DataFrame:
    """hold, t, x, y, mended: anchors in which single points, off the line between their neighbours where the measured head next to them is on it, are put back on the head. A neighbour that was put back counts as
    put back, so a hold's points are folded in order; a hold is seconds long."""
    ends = as_of(as_of(points, seen, ["hold"], "t", ["x", "y"]).withColumnsRenamed({f"{c}_r": f"{c}_p" for c in "txy"}), seen, ["hold"], "t", ["x", "y"], True)
    first = F.col("t_r").isNull() | (F.col("t") - F.col("t_p") <= F.col("t_r") - F.col("t"))
    near = F.when(F.coalesce(first, F.lit(False)) & F.col("t_p").isNotNull(), F.struct(*(F.col(f"{c}_p").alias(c) for c in "txy"))).otherwise(F.struct(*(F.col(f"{c}_r").alias(c) for c in "txy")))
    rows = ends.select("hold", F.struct("t", "x", "y", near.alias("near")).alias("q")).groupBy("hold").agg(F.array_sort(F.collect_list("q")).alias("q"))

    def step(acc: Column, k: Column) -> Column:
        a, p, b = acc[F.size(acc) - 1], F.col("q")[k], F.col("q")[k + 1]
        part = (p["t"] - a["t"]) / (b["t"] - a["t"])
        gx, gy = (a[c] + part * (b[c] - a[c]) for c in "xy")
        n = p["near"]
        stray = b.isNotNull() & (b["t"] - a["t"] <= 0.12) & (F.abs(n["t"] - p["t"]) <= 0.02) & (F.hypot(p["x"] - gx, p["y"] - gy) > 6) & (F.hypot(n["x"] - gx, n["y"] - gy) < 4)
        put = F.when(F.coalesce(stray, F.lit(False)), F.struct(p["t"].alias("t"), n["x"].alias("x"), n["y"].alias("y"), F.lit(True).alias("mended")))
        return F.array_append(acc, put.otherwise(F.struct(p["t"].alias("t"), p["x"].alias("x"), p["y"].alias("y"), F.lit(False).alias("mended"))))

    q0 = F.col("q")[0]
    start = F.array(F.struct(q0["t"].alias("t"), q0["x"].alias("x"), q0["y"].alias("y"), F.lit(False).alias("mended")))
    safe = rows.withColumn("q", F.concat("q", F.array(F.lit(None).cast(dict(rows.dtypes)["q"][6:-1]))))  # one beyond the last, for step's b
    return safe.select("hold", F.aggregate(F.when(F.size("q") > 2, F.sequence(F.lit(1), F.size("q") - 2)).otherwise(F.array().cast("array<int>")), start, step).alias("out")).select("hold", F.explode("out").alias("p")).select("hold", "p.*")


def moving_anchors(holds: DataFrame, body: DataFrame, anchors: DataFrame) -> DataFrame:
    """hold, t, x, y, source of the anchor path of every hold whose path is not empty: `measured` from the head after contact, `mended` or `given`.

    holds: hold, time, duration, x, y, precise (caps measured to the pixel). body: hold, t, x, y of the head. anchors: hold, t, x, y. The measured path counts where the anchor stands still while the head moves 8 pixels or more, and
    for precise caps where the anchor is more than 6 pixels off in three samples in a row or more than 12 in two. Holds without duration, or with one sample of the head after contact, keep their anchor."""
    h = holds.where("duration > 0").withColumn("end", F.col("time") + F.col("duration"))
    late = body.join(apart(h.select("hold", "time", "end")), "hold").where((F.col("t") > F.col("time")) & (F.col("t") <= F.col("end") + 0.035))
    late = late.withColumn("at", F.least("t", "end"))  # what was seen at one time, or after the end, counts once, as seen last
    seen = late.groupBy("hold", F.round("at", 5).alias("at_")).agg(F.max_by(F.struct(F.col("at").alias("t"), "x", "y"), "t").alias("p")).select("hold", "p.*")
    moved = seen.groupBy("hold").agg(F.count("*").alias("n"), F.min(F.struct("t", "x", "y")).alias("a"), F.max(F.struct("t", "x", "y")).alias("b")).where("n >= 2")
    moved = moved.withColumn("moved", F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")))
    old = anchors.groupBy("hold", "t").agg(F.min_by(F.struct("x", "y"), F.struct("x", "y")).alias("p")).select("hold", "t", "p.x", "p.y")
    size = anchors.groupBy("hold").agg(F.count("*").alias("points"))
    fine = apart(h.where("precise").select("hold").join(apart(moved.where("n >= 3").select("hold")), "hold").join(apart(size.where("points >= 2").select("hold")), "hold"))
    put = without_strays(old.join(fine, "hold"), apart(seen.join(fine, "hold")))
    # precise anchors against the head
    there = apart(seen.join(fine, "hold"))
    for c in "xy":
        there = apart(interpolate(put.select("hold", "t", c), there, "hold", "t", c).withColumnRenamed("interpolated", f"a{c}"))
    miss = F.hypot(F.col("ax") - F.col("x"), F.col("ay") - F.col("y"))
    rows_off = in_a_row(there, "hold", miss > 6)
    far = there.where(miss > 12).groupBy("hold").agg(F.count("*").alias("far"))
    contradicted = there.select("hold").distinct().join(apart(rows_off), "hold", "left").join(apart(far), "hold", "left").where((F.coalesce("longest", F.lit(0)) >= IN_A_ROW) | (F.coalesce("far", F.lit(0)) >= 2)).select("hold", F.lit(True).alias("contradicted"))
    # the path that counts
    base = put.withColumn("kept", F.lit(True)).unionByName(apart(anchors.join(fine, "hold", "left_anti").select("hold", "t", "x", "y", F.lit(False).alias("mended"))).withColumn("kept", F.lit(False)))
    still = base.groupBy("hold").agg(F.when(F.count("*") > 1, F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y"))).otherwise(0.0).alias("still"), F.max("mended").alias("any"))
    state = holds.select("hold", "time", "duration", "x", "y").join(apart(moved.select("hold", "moved", "b")), "hold", "left").join(apart(still), "hold", "left").join(apart(contradicted), "hold", "left")
    quiet = F.coalesce("still", F.lit(0.0)) < F.greatest(F.lit(6.0), 0.4 * F.col("moved"))
    measured = F.coalesce("contradicted", F.lit(False)) | ((F.col("moved") >= 8) & quiet)
    state = state.withColumn("source", F.when((F.col("duration") > 0) & F.coalesce(measured, F.lit(False)), "measured").when(F.coalesce("any", F.lit(False)), "mended").otherwise("given"))
    m = state.where("source = 'measured'").withColumn("end", F.col("time") + F.col("duration"))
    ends = m.select("hold", F.explode(F.filter(F.array(F.struct(F.col("time").alias("t"), "x", "y"), F.when(F.col("b.t") < F.col("end"), F.struct(F.col("end").alias("t"), F.col("b.x").alias("x"), F.col("b.y").alias("y")))), lambda p: p.isNotNull())).alias("p")).select("hold", "p.*")
    out = ends.unionByName(apart(seen.join(apart(m.select("hold")), "hold", "left_semi"))).withColumn("source", F.lit("measured"))
    kept = base.where("kept").join(apart(state.where("source = 'mended'").select("hold", "source")), "hold").select("hold", "t", "x", "y", "source")
    given = anchors.join(apart(state.where("source = 'given'").select("hold", "source")), "hold").select("hold", "t", "x", "y", "source")
    return out.unionByName(apart(kept)).unionByName(apart(given))


CONFIDENCE = {"high": 3, "medium": 2, "low": 1}


def same_sprites(events: DataFrame, points: DataFrame, overlap: float = 0.08, median: float = 10.0, close: float = 16.0, cell: float = 0.5, fps: float = 30.0) -> DataFrame:
    """video, a, b (a < b): pairs of events, one of them a fake and their types alike, whose paths run together for `overlap` seconds: at the times of both and at even ones the median distance is `median` pixels at most
    and three quarters are closer than `close`.

    Events meet by equality of cells of time; of those only pairs whose boxes come as near as `close` are sampled. events: video, event, fake, type; points: video, event, t, x, y, at least four distinct times."""
    p = points.groupBy("video", "event", "t").agg(F.min(F.struct("x", "y")).alias("p")).select("video", "event", "t", "p.x", "p.y")
    spans = p.groupBy("video", "event").agg(F.count("*").alias("n"), *(f(c).alias(f"{c}{k}") for c in "txy" for k, f in ((0, F.min), (1, F.max)))).where("n >= 4")
    e = events.select("video", "event", "fake", "type").join(apart(spans), ["video", "event"]).withColumn("cell", F.explode(F.sequence(F.floor(F.col("t0") / cell), F.floor(F.col("t1") / cell))))
    a, b = (e.select("video", "cell", *(F.col(c).alias(f"{c}_{side}") for c in ("event", "fake", "type", "t0", "t1", "x0", "x1", "y0", "y1"))) for side in "ab")
    lo, hi = F.greatest("t0_a", "t0_b"), F.least("t1_a", "t1_b")
    boxes = " AND ".join(f"{c}0_a - {close} < {c}1_b AND {c}0_b - {close} < {c}1_a" for c in "xy")
    met = a.join(apart(b), ["video", "cell"]).where("event_a < event_b AND (fake_a OR fake_b) AND coalesce(type_a = type_b, true)").where((hi - lo >= overlap) & F.expr(boxes))
    pairs = met.select("video", F.col("event_a").alias("a"), F.col("event_b").alias("b"), lo.alias("lo"), hi.alias("hi")).distinct()
    n = F.greatest(F.lit(5), F.floor((F.col("hi") - F.col("lo")) * fps).cast("int") + 1)
    even = pairs.select("video", "a", "b", "lo", "hi", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.when(k == n - 1, F.col("hi")).otherwise(F.col("lo") + k * (F.col("hi") - F.col("lo")) / (n - 1)))).alias("t"))
    # the points of both paths and the even times of a pair meet once; what came before and what comes next are found in two local sorts
    pair, at = ["video", "a", "b"], F.struct("t", "x", "y")
    none = F.lit(None).cast("struct<t:double,x:double,y:double>")
    own = pairs.select("*", F.explode(F.array(F.struct(F.col("a").alias("event"), F.lit(True).alias("first")), F.struct(F.col("b").alias("event"), F.lit(False).alias("first")))).alias("s")).select(*pair, "lo", "hi", "s.*")
    drawn = apart(own).join(p.select("video", "event", *(F.col(c).cast("double").alias(c) for c in "txy")), ["video", "event"]).select(*pair, "lo", "hi", "t", F.when(F.col("first"), at).alias("pa"), F.when(~F.col("first"), at).alias("pb"))
    rows = drawn.unionByName(even.select(*pair, "lo", "hi", "t", none.alias("pa"), none.alias("pb")))
    w, back = Window.partitionBy(*pair).orderBy("t"), Window.partitionBy(*pair).orderBy(F.desc("t"))
    last = lambda c, over: F.last(c, True).over(over.rangeBetween(Window.unboundedPreceding, 0))
    near = rows.select(*pair, "lo", "hi", "t", F.lag("t").over(w).alias("was"), *(last(f"p{s}", over).alias(f"{s}{k}") for over, k in ((w, 0), (back, 1)) for s in "ab"))
    near = near.where("t BETWEEN lo AND hi AND (was IS NULL OR was < t)")  # each time once

    def between(s: str, c: str) -> Column:
        l, r = F.col(f"{s}0"), F.col(f"{s}1")  # noqa: E741
        return F.when(l["t"] == r["t"], l[c]).otherwise(l[c] + (r[c] - l[c]) * (F.col("t") - l["t"]) / (r["t"] - l["t"]))

    far = near.select(*pair, *(between(s, c).alias(f"{c}{s}") for s in "ab" for c in "xy"))
    d = far.withColumn("d", F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")))
    fits = d.groupBy("video", "a", "b").agg(F.count("*").alias("n"), F.percentile("d", F.lit(0.5)).alias("m"), F.avg((F.col("d") < close).cast("double")).alias("near"))
    return fits.where((F.col("n") >= 4) & (F.col("m") <= median) & (F.col("near") >= 0.75)).select("video", "a", "b")


def sprite_duplicates(events: DataFrame, points: DataFrame, **limits) -> DataFrame:
    """video, event of the events that double another one's sprite. Pairs are settled in order of their first, then of their second event: the lesser by (real, points, frames, confidence) goes, the later of equals. An event that has
    gone meets no further pair, but pairs of an event that goes as the first of one are still settled. Pairs that can bear on each other are in one part, which is as long as a chain of sprites that are there twice.

    events: video, event, fake, type, frames, confidence (high, medium, low)."""
    from .parts import labels

    n = points.groupBy("video", "event").agg(F.countDistinct("t").alias("n"))
    level = F.coalesce(*(F.when(F.col("confidence") == k, v) for k, v in CONFIDENCE.items()), F.lit(0))
    rank = events.join(apart(n), ["video", "event"], "left").select("video", "event", F.struct(~F.col("fake"), F.coalesce("n", F.lit(0)), F.coalesce("frames", F.lit(0)), level).alias("rank"))
    pairs = held(same_sprites(events, points, **limits))  # few, and read by all that follows
    part = labels(pairs, ["video"])
    own = [apart(rank.select("video", F.col("event").alias(c), F.col("rank").alias(f"r{c}"))) for c in "ab"]
    named = pairs.join(own[0], ["video", "a"]).join(own[1], ["video", "b"]).join(apart(part.select("video", F.col("node").alias("a"), "part")), ["video", "a"])
    rows = named.groupBy("video", "part").agg(F.array_sort(F.collect_list(F.struct("a", "b", F.when(F.col("ra") >= F.col("rb"), F.col("b")).otherwise(F.col("a")).alias("goes")))).alias("pairs"))
    # gone: who has gone; first: whose pairs are being settled, and whether it was there when they began
    none = F.struct(F.array().cast("array<bigint>").alias("gone"), F.lit(None).cast("bigint").alias("first"), F.lit(True).alias("there"))

    def step(s: Column, p: Column) -> Column:
        there = F.when(s["first"].eqNullSafe(p["a"]), s["there"]).otherwise(~F.array_contains(s["gone"], p["a"]))
        ok = there & ~F.array_contains(s["gone"], p["b"])
        return F.struct(F.when(ok, F.array_append(s["gone"], p["goes"])).otherwise(s["gone"]).alias("gone"), p["a"].alias("first"), there.alias("there"))

    gone = rows.select("video", F.explode(F.array_distinct(F.aggregate("pairs", none, step)["gone"])).alias("event"))
    return gone.distinct()


def settled(pairs: DataFrame, ranks: DataFrame) -> DataFrame:
    """video, event of what goes when pairs (video, a, b) are settled in order and one of a pair goes, the lesser by rank, the later of equals; who has gone meets no further pair. ranks: video, event, rank."""
    from .parts import labels

    part = labels(pairs, ["video"])
    own = [apart(ranks.select("video", F.col("event").alias(c), F.col("rank").alias(f"r{c}"))) for c in "ab"]
    named = pairs.join(own[0], ["video", "a"]).join(own[1], ["video", "b"]).join(apart(part.select("video", F.col("node").alias("a"), "part")), ["video", "a"])
    rows = named.groupBy("video", "part").agg(F.array_sort(F.collect_list(F.struct("a", "b", F.when(F.col("ra") >= F.col("rb"), F.col("b")).otherwise(F.col("a")).alias("goes")))).alias("pairs"))

    def step(gone: Column, p: Column) -> Column:
        return F.when(F.array_contains(gone, p["a"]) | F.array_contains(gone, p["b"]), gone).otherwise(F.array_append(gone, p["goes"]))

    return rows.select("video", F.explode(F.aggregate("pairs", F.array().cast("array<bigint>"), step)).alias("event"))


#: How near in time and place two events are of one target, how long paths run together and how near, and how near contacts are.
SAME, ALONG, TOUCH = (0.055, 44.0), (0.065, 20.0), (0.045, 36.0)


def hollow_pairs(events: DataFrame, points: DataFrame, same: tuple = SAME, along: tuple = ALONG, touch: tuple = TOUCH, samples: int = 9, cell: float = 0.5) -> DataFrame:
    """video, a, b: pairs of events that may be one hollow note: of one target, near in time and at their ends; or with paths that run together, by the median distance at `samples` even times; or with contacts near in time and
    place. events: video, event, time, target (or null); points: video, event, t, x, y, two times or more. Events meet by cells of time, over their paths and contacts."""
    p = points.groupBy("video", "event", "t").agg(F.min(F.struct("x", "y")).alias("p")).select("video", "event", "t", "p.x", "p.y")
    spans = p.groupBy("video", "event").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.max(F.struct("t", "x", "y")).alias("z")).where("n >= 2")
    e = events.select("video", "event", "time", "target").join(apart(spans), ["video", "event"]).select("video", "event", "time", "target", "t0", "t1", F.col("z.x").alias("x"), F.col("z.y").alias("y"))
    reach = max(same[0], touch[0])
    lo, hi = F.least("t0", F.col("time") - reach), F.greatest("t1", F.col("time") + reach)
    c = e.withColumn("cell", F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell))))
    a, b = (c.select("video", "cell", *(F.col(k).alias(f"{k}_{side}") for k in ("event", "time", "target", "t0", "t1", "x", "y"))) for side in "ab")
    met = a.join(apart(b), ["video", "cell"]).where("event_a < event_b").drop("cell").distinct()
    dt, far = F.abs(F.col("time_a") - F.col("time_b")), F.hypot(F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b"))
    near = F.coalesce((F.col("target_a") == F.col("target_b")) & (dt < same[0]) & (far < same[1]), F.lit(False)) | ((dt < touch[0]) & (far < touch[1]))
    sure = met.where(near).select("video", F.col("event_a").alias("a"), F.col("event_b").alias("b"))
    low, high = F.greatest("t0_a", "t0_b"), F.least("t1_a", "t1_b")
    open_ = met.where(~near & (high - low >= along[0])).select("video", F.col("event_a").alias("a"), F.col("event_b").alias("b"), low.alias("lo"), high.alias("hi"))
    times = open_.select("video", "a", "b", F.explode(F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: F.when(k == samples - 1, F.col("hi")).otherwise(F.col("lo") + k * (F.col("hi") - F.col("lo")) / (samples - 1)))).alias("t"))
    both = None
    for side in "ab":
        at = apart(times.select(F.struct("video", F.col(side).alias("event")).alias("path"), "video", "a", "b", "t"))
        for k in "xy":
            at = apart(interpolate(apart(p.select(F.struct("video", "event").alias("path"), "t", k)), at, "path", "t", k).withColumnRenamed("interpolated", f"{k}{side}"))
        at = apart(at.drop("path"))
        both = at if both is None else both.join(at, ["video", "a", "b", "t"])
    d = F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb"))
    run = both.groupBy("video", "a", "b").agg(F.percentile(d, F.lit(0.5)).alias("m")).where(F.col("m") < along[1]).select("video", "a", "b")
    return sure.unionByName(apart(run))


def hollow_duplicates(events: DataFrame, points: DataFrame, **limits) -> DataFrame:
    """video, event of the events that double another hollow note: of a pair the lesser by support goes, 8 for a target, 2 ring + head and up to 3 for the path. events: video, event, time, target, ring, head."""
    n = points.groupBy("video", "event").agg(F.countDistinct("t").alias("n"))
    support = F.when(F.col("target").isNotNull(), 8.0).otherwise(0.0) + 2 * F.coalesce("ring", F.lit(0.0)) + F.coalesce("head", F.lit(0.0)) + F.least(F.lit(3.0), 0.12 * F.coalesce("n", F.lit(0)))
    ranks = events.join(apart(n), ["video", "event"], "left").select("video", "event", F.round(support, 9).alias("rank"))
    return settled(hollow_pairs(events, points, **limits), ranks)


def path_matches(paths: DataFrame, others: DataFrame, close: float, least: int, cell: float = 0.5) -> DataFrame:
    """video, a, b, n: how many samples of a path lie closer than `close` to where another path is at their times, where `least` do. paths and others: video, event, t, x, y. A sample meets the paths that are there in its
    cell of time, and those have a place at its time between their own samples."""
    q = others.groupBy("video", "event", "t").agg(F.min(F.struct("x", "y")).alias("p")).select("video", "event", "t", "p.x", "p.y")
    w = Window.partitionBy("video", "event").orderBy("t")
    legs = q.select("video", F.col("event").alias("b"), F.col("t").alias("t0"), F.col("x").alias("x0"), F.col("y").alias("y0"), *(F.coalesce(F.lead(c).over(w), F.col(c)).alias(f"{c}1") for c in "txy"), F.lead("t").over(w).isNull().alias("last"))
    legs = legs.withColumn("cell", F.explode(F.sequence(F.floor(F.col("t0") / cell), F.floor(F.col("t1") / cell))))
    samples = paths.select("video", F.col("event").alias("a"), "t", "x", "y").withColumn("cell", F.floor(F.col("t") / cell))
    there = (F.col("t") >= F.col("t0")) & ((F.col("t") < F.col("t1")) | (F.col("last") & (F.col("t") == F.col("t0"))))
    met = apart(samples).join(apart(legs), ["video", "cell"]).where("a <> b").where(there)
    part = F.when(F.col("t1") > F.col("t0"), (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))).otherwise(0.0)
    off = F.hypot(F.col("x") - F.col("x0") - part * (F.col("x1") - F.col("x0")), F.col("y") - F.col("y0") - part * (F.col("y1") - F.col("y0")))
    return met.where(off < close).groupBy("video", "a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def extended_by(events: DataFrame, tracks: DataFrame, close: float = 24.0, least: int = 3, cell: float = 0.5) -> DataFrame:
    """video, event, t, x, y, track of the points that decorative tracks add to events: a track goes to the first event on whose path `least` of its samples lie, and gives it what it has before and after that path. Tracks are held
    against the paths that events have of their own; of points at one time the first track's counts. events and tracks: video, event, t, x, y."""
    own = path_matches(tracks, events, close, least, cell).groupBy("video", "a").agg(F.min("b").alias("event"))
    span = events.groupBy("video", "event").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    points = tracks.select("video", F.col("event").alias("a"), "t", "x", "y").join(apart(own), ["video", "a"]).join(apart(span), ["video", "event"])
    beyond = points.where((F.col("t") < F.col("t0")) | (F.col("t") > F.col("t1")))
    return beyond.groupBy("video", "event", "t").agg(F.min(F.struct("a", "x", "y")).alias("p")).select("video", "event", "t", "p.x", "p.y", F.col("p.a").alias("track"))
