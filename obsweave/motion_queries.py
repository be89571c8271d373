"""Queries on the motion of tracked things and on joins in time and place, with the DuckDB SQL that gives the same rows."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions.scalar import clip
from .operators import greedy, joins, motion, ordered
from .plans.templates import best_two, passes
from .queries import DAY, HOLDS, HOUR, OBS, query, r, w
from .sources.shared import held
from .sources.tables import holds, observations, table

Q = "WINDOW q AS (PARTITION BY track ORDER BY t, id)"


@query("q60_frame_join", f"""
WITH {OBS}, f AS (SELECT *, CAST(round_even(t / 7200, 0) AS BIGINT) AS frame FROM obs)
SELECT a.frame, count(*) AS pairs, round(sum(abs(a.x - b.x)), 3) AS gap FROM f a JOIN f b ON a.frame = b.frame AND a.track = b.track WHERE a.kind = 'view' AND b.kind = 'purchase' GROUP BY a.frame""")
def q60(spark, d):
    f = observations(spark, d).withColumn("frame", F.rint(F.col("t") / 7200).cast("long"))
    a, b = f.where("kind = 'view'").select("track", "frame", "x"), f.where("kind = 'purchase'").select("track", "frame", F.col("x").alias("x_r"))
    return a.join(b, ["track", "frame"]).groupBy("frame").agg(F.count("*").alias("pairs"), r(F.sum(F.abs(F.col("x") - F.col("x_r"))), 3).alias("gap"))


@query("q61_last_points_contact", f"""
WITH {OBS}, v AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY t DESC, id DESC) AS k FROM obs WHERE kind = 'view'), g AS (SELECT * FROM obs WHERE kind = 'purchase'),
c AS (SELECT v.track, v.id, g.id AS target, row_number() OVER (PARTITION BY v.track, v.id ORDER BY abs(g.y - v.y), g.id) AS j, g.t - v.t AS dt FROM v JOIN g ON g.track = v.track AND g.t - v.t BETWEEN -14400 AND 64800 WHERE v.k <= 8 AND abs(g.y - v.y) < 15)
SELECT track, id, target, round(dt, 3) AS dt FROM c WHERE j = 1""")
def q61(spark, d):
    o = observations(spark, d).select("track", "id", "t", "y", "kind")
    v = o.where("kind = 'view'").withColumn("k", F.row_number().over(Window.partitionBy("track").orderBy(F.desc("t"), F.desc("id")))).where("k <= 8")
    got = motion.attach(v.select("track", "id", "t", "y"), o.where("kind = 'purchase'").select("track", "id", "t", "y"), ["track"], "t", -4 * HOUR, 18 * HOUR, F.abs(F.col("y_r") - F.col("y")) < 15, F.abs(F.col("y_r") - F.col("y")), "id_r")
    return got.select("track", "id", F.col("id_r").alias("target"), r(F.col("t_r") - F.col("t"), 3).alias("dt"))


@query("q62_occluded_recovery", f"""
WITH {OBS}, p AS (SELECT *, first_value(t) OVER f AS t0, first_value(y) OVER f AS y0 FROM obs WINDOW f AS (PARTITION BY track ORDER BY t, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
s AS (SELECT *, (y - y0) / nullif((t - t0) / 3600, 0) AS v FROM p), e AS (SELECT * FROM s WHERE kind = 'error' AND abs(v) BETWEEN 0.5 AND 24),
c AS (SELECT e.track, e.id, e.t, e.y, g.id AS target, g.t AS gt, g.y AS gy, abs(e.y + e.v * (g.t - e.t) / 3600 - g.y) AS miss FROM e JOIN obs g ON g.track = e.track AND g.kind = 'purchase' AND g.t - e.t BETWEEN -7200 AND 86400),
k AS (SELECT *, row_number() OVER (PARTITION BY track, id ORDER BY round(miss + abs(gt - t) / 3600 * 0.15, 6), target) AS j FROM c WHERE miss < 40), b AS (SELECT * FROM k WHERE j = 1)
SELECT track, id, target, round(miss, 4) AS miss FROM b WHERE NOT EXISTS (SELECT 1 FROM obs z WHERE z.track = b.track AND z.kind = 'click' AND abs(z.t - b.gt) < 3600 AND abs(z.y - b.gy) < 35)""")
def q62(spark, d):
    o = observations(spark, d).select("track", "id", "t", "y", "kind")
    e = motion.trailing_velocity(o.withColumn("h", F.col("t") / 3600), ["track"], ["t", "id"], "h", ["y"]).where("kind = 'error' AND abs(v_y) BETWEEN 0.5 AND 24")
    c = joins.band_join(e.select("track", "id", "t", "y", "v_y"), o.where("kind = 'purchase'").select("track", "id", "t", "y"), ["track"], "t", -2 * HOUR, DAY)
    c = c.withColumn("miss", F.abs(F.col("y") + F.col("v_y") * (F.col("t_r") - F.col("t")) / 3600 - F.col("y_r"))).where("miss < 40")
    b = joins.argmin_per(c, ["track", "id"], r(F.col("miss") + F.abs(F.col("t_r") - F.col("t")) / 3600 * 0.15, 6), "id_r")
    b = b.select("track", "id", F.col("id_r").alias("target"), "miss", F.col("t_r").alias("t"), F.col("y_r").alias("y"))
    rest = motion.without(b, o.where("kind = 'click'").select("track", "t", "y"), ["track"], "t", -HOUR, HOUR, (F.abs(F.col("t_r") - F.col("t")) < HOUR) & (F.abs(F.col("y_r") - F.col("y")) < 35))
    return rest.select("track", "id", "target", r("miss").alias("miss"))


@query("q63_ring_attachment", f"""
WITH {OBS}, g AS (SELECT a.track, a.id, a.t, a.y, a.x - 0.95 * coalesce(max(b.x), 0) AS fresh FROM obs a LEFT JOIN obs b ON a.track = b.track AND b.t < a.t AND b.t >= a.t - 172800 AND abs(a.y - b.y) <= 20 WHERE a.kind = 'click' GROUP BY a.track, a.id, a.t, a.y, a.x),
c AS (SELECT e.track, e.id, g.id AS ring, g.fresh, row_number() OVER (PARTITION BY e.track, e.id ORDER BY round(abs(g.y - e.y) + 0.5 * abs(g.t - e.t) / 3600 - 0.02 * g.fresh, 6), g.id) AS k FROM obs e JOIN g ON g.track = e.track AND g.t - e.t BETWEEN -57600 AND 82800 WHERE e.kind = 'view' AND abs(g.y - e.y) <= 30 AND g.fresh > 5)
SELECT track, id, ring, round(fresh, 4) AS fresh FROM c WHERE k = 1""")
def q63(spark, d):
    o = observations(spark, d)
    clicks = o.where("kind = 'click'").select("track", "id", "t", "x", "y")
    prior = joins.band_join(clicks.select("track", "id", "t", "y"), o.select("track", "t", "x", "y"), ["track"], "t", -2 * DAY, 0.0).where("t_r < t AND abs(y - y_r) <= 20").groupBy("track", "id").agg(F.max("x_r").alias("m"))
    rings = clicks.join(prior, ["track", "id"], "left").select("track", "id", "t", "y", (F.col("x") - 0.95 * F.coalesce("m", F.lit(0.0))).alias("fresh")).where("fresh > 5")
    dy, dt = F.abs(F.col("y_r") - F.col("y")), F.abs(F.col("t_r") - F.col("t")) / 3600
    got = motion.attach(o.where("kind = 'view'").select("track", "id", "t", "y"), rings, ["track"], "t", -16 * HOUR, 23 * HOUR, dy <= 30, r(dy + 0.5 * dt - 0.02 * F.col("fresh_r"), 6), "id_r")
    return got.select("track", "id", F.col("id_r").alias("ring"), r("fresh_r").alias("fresh"))


@query("q64_support_window", f"""
WITH {OBS}, c AS (SELECT e.track, e.id, max(g.x) FILTER (g.t >= e.t) AS a, max(g.x) FILTER (g.t < e.t) AS b FROM obs e JOIN obs g ON g.track = e.track AND g.kind = 'click' AND g.t - e.t BETWEEN -43200 AND 86400 AND abs(g.y - e.y) <= 20 WHERE e.kind = 'view' GROUP BY e.track, e.id)
SELECT e.track, e.id, round(greatest(0, coalesce(a, 0) - 0.95 * coalesce(b, 0)), 4)::DOUBLE AS support FROM obs e LEFT JOIN c ON c.track = e.track AND c.id = e.id WHERE e.kind = 'view'""")
def q64(spark, d):
    o = observations(spark, d)
    got = motion.window_support(o.where("kind = 'view'").select("track", "id", "t", "y"), o.where("kind = 'click'").select("track", "t", "x", "y"), ["track"], "t", "x", F.abs(F.col("y_r") - F.col("y")) <= 20, 12 * HOUR, 24 * HOUR)
    return got.select("track", "id", r("support").alias("support"))


@query("q65_local_energy", f"""
WITH {OBS}, c AS (SELECT e.track, e.id, g.t - e.t AS dt, g.x * exp(-(g.y - e.y) * (g.y - e.y) / (2 * 30.0 * 30.0)) AS p FROM obs e JOIN obs g ON g.track = e.track AND g.kind = 'click' AND g.t - e.t BETWEEN -68400 AND 43200 WHERE e.kind = 'view'),
m AS (SELECT track, id, max(p) FILTER (abs(dt - 14400) < 7200 OR abs(dt - 36000) < 7200) AS a, max(p) FILTER (abs(dt + 36000) < 7200 OR abs(dt + 61200) < 7200) AS b FROM c GROUP BY track, id)
SELECT e.track, e.id, round(greatest(0, coalesce(a, 0) - 0.65 * coalesce(b, 0)), 4)::DOUBLE AS support FROM obs e LEFT JOIN m ON m.track = e.track AND m.id = e.id WHERE e.kind = 'view'""")
def q65(spark, d):
    o = observations(spark, d)
    got = motion.local_energy(o.where("kind = 'view'").select("track", "id", "t", "y"), o.where("kind = 'click'").select("track", "t", "x", "y"), ["track"], "t", "y", "x", {"before": [-10 * HOUR, -17 * HOUR], "after": [4 * HOUR, 10 * HOUR]}, 2 * HOUR, 30.0)
    return got.select("track", "id", r("support").alias("support"))


@query("q66_duplicate_semi", f"""
WITH {OBS}, e AS (SELECT * FROM obs WHERE kind = 'error'), g AS (SELECT * FROM obs WHERE kind = 'view' AND x >= 60)
SELECT track, id FROM e WHERE EXISTS (SELECT 1 FROM g WHERE g.track = e.track AND abs(g.t - e.t) <= 21600 AND abs(g.y - e.y) < 30)""")
def q66(spark, d):
    o = observations(spark, d)
    e = o.where("kind = 'error'").select("track", "id", "t", "y")
    hit = joins.band_join(e, o.where("kind = 'view' AND x >= 60").select("track", "t", "y"), ["track"], "t", -6 * HOUR, 6 * HOUR).where("abs(y_r - y) < 30").select("track", "id").distinct()
    return e.join(hit, ["track", "id"], "left_semi").select("track", "id")


@query("q67_represented_tracks", f"""
WITH {OBS}, f AS (SELECT kind, track, CAST(round_even(t / 21600, 0) AS BIGINT) AS frame, min(y) AS y FROM obs GROUP BY 1, 2, 3),
p AS (SELECT a.kind, a.track AS a, b.track AS b, count(*) AS n, median(abs(a.y - b.y)) AS med, avg(CASE WHEN abs(a.y - b.y) < 30 THEN 1.0 ELSE 0.0 END) AS share FROM f a JOIN f b ON a.kind = b.kind AND a.frame = b.frame AND a.track <> b.track GROUP BY a.kind, a.track, b.track)
SELECT DISTINCT kind, track FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.kind = f.kind AND p.a = f.track AND n >= 4 AND med < 18 AND share >= 0.7)""")
def q67(spark, d):
    f = observations(spark, d).groupBy("kind", "track", F.rint(F.col("t") / 21600).cast("long").alias("frame")).agg(F.min("y").alias("y"))
    return motion.unrepresented(f, 4, 18, 30, 0.7).select("kind", "track")


@query("q68_grid_match_ratio", f"""
WITH {OBS}, n AS (SELECT track, id, CAST(round_even(t / 7200, 0) AS BIGINT) AS a, CAST(round_even(y / 10, 0) AS BIGINT) AS c, kind FROM obs), g AS (SELECT DISTINCT a, c FROM n WHERE kind = 'click'),
m AS (SELECT track, id, EXISTS (SELECT 1 FROM g WHERE abs(n.a - g.a) <= 1 AND abs(n.c - g.c) <= 1) AS hit FROM n WHERE kind = 'view')
SELECT track, count(*) AS n, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 5) AS ratio FROM m GROUP BY track""")
def q68(spark, d):
    o = observations(spark, d).select("track", "id", "t", "y", "kind")
    v = o.where("kind = 'view'")
    hit = joins.grid_semi(v, o.where("kind = 'click'"), {"t": 7200.0, "y": 10.0}).select("track", "id").withColumn("hit", F.lit(1.0))
    return v.join(hit, ["track", "id"], "left").groupBy("track").agg(F.count("*").alias("n"), r(F.avg(F.coalesce("hit", F.lit(0.0))), 5).alias("ratio"))


@query("q69_repeated_hit", f"""
WITH {HOLDS} SELECT a.ok, a.ln, a.pk, round(a.price, 2) AS price FROM holds a WHERE EXISTS (SELECT 1 FROM holds b WHERE b.pk = a.pk AND b.ok <> a.ok AND abs(b.t - a.t) < 950400 AND b.ring >= 0.06)""")
def q69(spark, d):
    h = holds(spark, d).select("ok", "ln", "pk", "t", "ring", "price").withColumn("row", F.monotonically_increasing_id())
    hit = joins.band_join(h.select("row", "pk", "ok", "t"), h.where("ring >= 0.06").select("pk", "ok", "t"), ["pk"], "t", -11 * DAY, 11 * DAY).where((F.col("ok") != F.col("ok_r")) & (F.abs(F.col("t_r") - F.col("t")) < 11 * DAY)).select("row").distinct()
    return h.join(hit, "row", "left_semi").select("ok", "ln", "pk", r("price", 2).alias("price"))


@query("q70_track_samples", f"""
WITH {OBS}, s AS (SELECT kind, track, count(*) AS samples, median(x) AS med FROM obs GROUP BY kind, track)
SELECT o.id, s.samples, round(s.med, 4) AS med, o.x < 0.45 * s.med AS thin FROM obs o JOIN s ON o.kind = s.kind AND o.track = s.track WHERE o.kind IN ('view', 'click')""")
def q70(spark, d):
    o = observations(spark, d)
    s = o.groupBy("kind", "track").agg(F.count("*").alias("samples"), F.percentile("x", F.lit(0.5)).alias("med"))
    return o.where("kind IN ('view', 'click')").join(s, ["kind", "track"]).select("id", "samples", r("med").alias("med"), (F.col("x") < 0.45 * F.col("med")).alias("thin"))


@query("q71_span_index", f"""
WITH {OBS}, i AS (SELECT *, lag(t) OVER (PARTITION BY track ORDER BY t, id) AS p FROM obs), g AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS k FROM i),
s AS (SELECT track, CAST(k AS BIGINT) AS k, min(t) AS lo, max(t) AS hi, last(y ORDER BY t, id) AS y FROM g GROUP BY track, k HAVING count(*) >= 2)
SELECT e.track, e.id, s.track AS other, s.k AS span FROM obs e JOIN s ON e.t - s.hi <= 14400 AND e.t - s.lo >= 43200 AND e.t >= s.lo AND e.y = s.y WHERE e.kind = 'error'""")
def q71(spark, d):
    o = observations(spark, d).select("track", "id", "t", "y", "kind")
    s = ordered.gap_islands(o, ["track"], "t", 12 * HOUR, "id", "span").groupBy("track", "span").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.max_by("y", F.struct("t", "id")).alias("y"), F.count("*").alias("n")).where("n >= 2")
    # a span stands in every day from which it can be met, with a second to spare; a probe looks into its own day, so it meets a span once
    late = s.where("hi - lo >= 8 * 3600 - 1").withColumn("day", F.explode(F.sequence(F.floor((F.col("lo") + 12 * HOUR - 1) / DAY), F.floor((F.col("hi") + 4 * HOUR + 1) / DAY))))
    e = o.where("kind = 'error'").select("track", "id", "t", "y", F.floor(F.col("t") / DAY).alias("day"))
    return e.join(late.select(F.col("track").alias("other"), "span", "lo", "hi", "y", "day"), ["day", "y"]).where((F.col("t") - F.col("hi") <= 4 * HOUR) & (F.col("t") - F.col("lo") >= 12 * HOUR) & (F.col("t") >= F.col("lo"))).select("track", "id", "other", "span")


@query("q72_rendered_match", f"""
WITH {OBS}, c AS (SELECT a.track, a.id, b.id AS other, row_number() OVER (PARTITION BY a.track, a.id ORDER BY round(abs(a.x - b.x) + abs(a.y - b.y), 6), b.id) AS k, abs(a.x - b.x) + abs(a.y - b.y) AS score FROM obs a JOIN obs b ON a.track = b.track AND a.kind = b.kind AND a.id <> b.id AND abs(b.t - a.t) <= 36000)
SELECT track, id, other, round(score, 4) AS score FROM c WHERE k = 1""")
def q72(spark, d):
    o = observations(spark, d)
    score = F.abs(F.col("x") - F.col("x_r")) + F.abs(F.col("y") - F.col("y_r"))
    j = motion.attach(o, o, ["track", "kind"], "t", -10 * HOUR, 10 * HOUR, F.col("id") != F.col("id_r"), r(score, 6), "id_r")
    return j.select("track", "id", F.col("id_r").alias("other"), r(score).alias("score"))


@query("q73_merge_repairs", f"""
WITH {OBS} SELECT track, id FROM obs e WHERE kind = 'error' AND NOT EXISTS (SELECT 1 FROM obs h WHERE h.track = e.track AND h.kind = 'purchase' AND abs(e.t - h.t) < 37800 AND sqrt((e.x - h.x) * (e.x - h.x) + (e.y - h.y) * (e.y - h.y)) < 38)""")
def q73(spark, d):
    o = observations(spark, d).select("track", "id", "t", "x", "y", "kind")
    near = (F.abs(F.col("t_r") - F.col("t")) < 37800) & (F.hypot(F.col("x") - F.col("x_r"), F.col("y") - F.col("y_r")) < 38)
    return motion.without(o.where("kind = 'error'"), o.where("kind = 'purchase'").select("track", "t", "x", "y"), ["track"], "t", -37800.0, 37800.0, near).select("track", "id")


@query("q74_pairs_once_each", f"""
WITH {OBS}, p AS (SELECT a.track, round(b.t - a.t, 3) AS gap, a.id AS a, b.id AS b FROM obs a JOIN obs b ON a.track = b.track AND b.t - a.t >= 600 AND b.t - a.t <= 21600 AND abs(a.y - b.y) <= 65),
l AS (SELECT track, list({{'gap': gap, 'a': a, 'b': b}} ORDER BY gap, a, b) AS v FROM p GROUP BY track),
f AS (SELECT track, list_reduce(list_transform(v, lambda e: [e]), lambda acc, e: CASE WHEN len(list_filter(acc, lambda z: z.a = e[1].a OR z.b = e[1].b OR z.a = e[1].b OR z.b = e[1].a)) > 0 THEN acc ELSE list_concat(acc, e) END) AS k FROM l)
SELECT track, u.a AS first, u.b AS second, u.gap AS gap FROM (SELECT track, unnest(k) AS u FROM f)""")
def q74(spark, d):
    o = observations(spark, d).select("track", "id", "t", "y")
    p = joins.band_join(o, o, ["track"], "t", 600.0, 6 * HOUR).where("abs(y - y_r) <= 65").select("track", r(F.col("t_r") - F.col("t"), 3).alias("gap"), F.col("id").alias("a"), F.col("id_r").alias("b"))
    return motion.once_each(p, ["track"], "a", "b", ["gap", "a", "b"]).select("track", F.col("a").alias("first"), F.col("b").alias("second"), "gap")


@query("q75_ordinal_nudge", f"""
WITH {OBS}, n AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY t, id) - 1 AS place FROM obs WHERE kind <> 'signup'), b AS (SELECT track, y AS place, min(t) AS judged FROM obs WHERE kind = 'error' GROUP BY track, y)
SELECT n.track, n.id, round(n.t, 3) AS was, round(n.t + 120, 3) AS now FROM n JOIN b ON n.track = b.track AND n.place = b.place WHERE b.judged < n.t - 0.36 AND NOT (n.x >= 90 AND n.y >= 90)""")
def q75(spark, d):
    o = observations(spark, d)
    n = o.where("kind <> 'signup'").withColumn("place", F.row_number().over(w()) - 1)
    b = o.where("kind = 'error'").groupBy("track", F.col("y").alias("place")).agg(F.min("t").alias("judged"))
    hit = n.join(b, ["track", "place"]).where("judged < t - 0.36 AND NOT (x >= 90 AND y >= 90)")
    return hit.select("track", "id", r("t", 3).alias("was"), r(F.col("t") + 120, 3).alias("now"))


@query("q76_summary_counters", f"""
WITH {HOLDS}, o AS (SELECT median(price) AS m, count(*) AS n FROM holds WHERE frames >= 8 AND price BETWEEN 1000 AND 90000)
SELECT count(*) AS candidates, CAST(sum(CASE WHEN fake THEN 0 WHEN duration > 0 THEN 2 ELSE 1 END) AS BIGINT) AS judgements, count(*) FILTER (fake) AS fakes, round(coalesce(any_value(o.m), 950), 3) AS speed, round(avg(CASE WHEN price < 30000 THEN 1.0 ELSE 0.0 END), 6) AS close FROM holds, o""")
def q76(spark, d):
    good = F.when((F.col("frames") >= 8) & F.col("price").between(1000, 90000), F.col("price"))
    return holds(spark, d).agg(F.count("*").alias("candidates"), F.sum(F.when(F.col("fake"), 0).when(F.col("duration") > 0, 2).otherwise(1)).alias("judgements"), F.count_if("fake").alias("fakes"), r(F.coalesce(F.percentile(good, F.lit(0.5)), F.lit(950.0)), 3).alias("speed"), r(F.avg(F.when(F.col("price") < 30000, 1.0).otherwise(0.0)), 6).alias("close"))


@query("q77_uncut_percentile", f"""
WITH {OBS}, g AS (SELECT track, count(*) FILTER (y BETWEEN 20 AND 80) AS uncut, quantile_cont(x, 0.65) FILTER (y BETWEEN 20 AND 80) AS a, quantile_cont(x, 0.75) AS b FROM obs GROUP BY track)
SELECT track, uncut, round(CASE WHEN uncut >= 40 THEN a ELSE b END, 4) AS length FROM g""")
def q77(spark, d):
    inside = F.col("y").between(20, 80)
    g = observations(spark, d).groupBy("track").agg(F.count_if(inside).alias("uncut"), F.percentile(F.when(inside, F.col("x")), F.lit(0.65)).alias("a"), F.percentile("x", F.lit(0.75)).alias("b"))
    return g.select("track", "uncut", r(F.when(F.col("uncut") >= 40, F.col("a")).otherwise(F.col("b"))).alias("length"))


@query("q78_effect_delay", f"""
WITH {OBS}, f AS (SELECT e.track, e.id, min(g.t - e.t) AS onset FROM obs e JOIN obs g ON g.track = e.track AND g.kind = 'click' AND g.t - e.t BETWEEN 0 AND 86400 WHERE e.kind = 'view' GROUP BY e.track, e.id)
SELECT track, count(*) AS n, round(CASE WHEN count(*) >= 8 THEN median(onset) ELSE 7200 END, 3) AS delay FROM f GROUP BY track""")
def q78(spark, d):
    o = observations(spark, d).select("track", "id", "t", "kind")
    f = joins.band_join(o.where("kind = 'view'"), o.where("kind = 'click'"), ["track"], "t", 0.0, DAY).groupBy("track", "id").agg(F.min(F.col("t_r") - F.col("t")).alias("onset"))
    return f.groupBy("track").agg(F.count("*").alias("n"), r(F.when(F.count("*") >= 8, F.percentile("onset", F.lit(0.5))).otherwise(7200.0), 3).alias("delay"))


@query("q79_row_edges", f"""
WITH {OBS}, f AS (SELECT CAST(floor(t / 10800) AS BIGINT) AS frame, x, id FROM obs), l AS (SELECT frame, x, id, lead(x) OVER (PARTITION BY frame ORDER BY x, id) - x AS gap FROM f),
m AS (SELECT frame, count(gap) AS n, median(gap) AS med, min(x) AS first FROM l GROUP BY frame HAVING count(gap) >= 4), s AS (SELECT l.frame, median(abs(l.gap - m.med)) AS mad FROM l JOIN m USING (frame) WHERE l.gap IS NOT NULL GROUP BY l.frame)
SELECT m.frame, m.n, round(m.first - m.med, 4) AS edge FROM m JOIN s USING (frame) WHERE m.med BETWEEN 2 AND 30 AND s.mad <= 8""")
def q79(spark, d):
    l = observations(spark, d).select(F.floor(F.col("t") / 10800).alias("frame"), "x", "id").withColumn("gap", F.lead("x").over(Window.partitionBy("frame").orderBy("x", "id")) - F.col("x"))  # noqa: E741
    m = l.groupBy("frame").agg(F.count("gap").alias("n"), F.percentile("gap", F.lit(0.5)).alias("med"), F.min("x").alias("first")).where("n >= 4")
    s = l.join(m, "frame").groupBy("frame").agg(F.percentile(F.abs(F.col("gap") - F.col("med")), F.lit(0.5)).alias("mad"))
    return m.join(s, "frame").where("med BETWEEN 2 AND 30 AND mad <= 8").select("frame", "n", r(F.col("first") - F.col("med")).alias("edge"))


@query("q80_frame_difference", """
WITH e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, median(v) AS m FROM e GROUP BY label, i)
SELECT vec_id, round(avg(abs(v - m)), 5) AS mean_abs, round(avg(abs(v - m)) FILTER (i <= 32), 5) AS upper, round(avg(abs(v - m)) FILTER (i > 32), 5) AS lower, round(avg(CASE WHEN abs(v - m) > 0.1 THEN 1.0 ELSE 0.0 END), 5) AS changed FROM e JOIN m USING (label, i) GROUP BY vec_id""")
def q80(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    m = e.groupBy("label", "i").agg(F.percentile("v", F.lit(0.5)).alias("m"))
    gap = F.abs(F.col("v") - F.col("m"))
    return e.join(m, ["label", "i"]).groupBy("vec_id").agg(r(F.avg(gap), 5).alias("mean_abs"), r(F.avg(F.when(F.col("i") < 32, gap)), 5).alias("upper"), r(F.avg(F.when(F.col("i") >= 32, gap)), 5).alias("lower"), r(F.avg(F.when(gap > 0.1, 1.0).otherwise(0.0)), 5).alias("changed"))


@query("q81_trajectory_error", f"""
WITH {OBS}, s AS (SELECT track, list(abs(x - y) ORDER BY abs(x - y)) AS v, count(*) AS n FROM obs GROUP BY track HAVING count(*) >= 8)
SELECT track, n, round(v[1 + CAST(floor((n - 1) * 0.5) AS BIGINT)], 4) AS p50, round(v[1 + CAST(floor((n - 1) * 0.9) AS BIGINT)], 4) AS p90, round(v[1 + CAST(floor((n - 1) * 0.9) AS BIGINT)] + 0.8 * v[1 + CAST(floor((n - 1) * 0.5) AS BIGINT)], 4) AS score FROM s""")
def q81(spark, d):
    gap = F.abs(F.col("x") - F.col("y"))
    s = observations(spark, d).groupBy("track").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(gap)).alias("v")).where("n >= 8")
    at = lambda p: F.element_at("v", (F.floor((F.col("n") - 1) * p) + 1).cast("int"))
    return s.select("track", "n", r(at(0.5)).alias("p50"), r(at(0.9)).alias("p90"), r(at(0.9) + 0.8 * at(0.5)).alias("score"))


@query("q82_track_quality", f"""
WITH {OBS}, s AS (SELECT *, abs(y - lag(y) OVER q) / nullif((t - lag(t) OVER q) / 3600, 0) AS rate FROM obs {Q}), g AS (SELECT track, median(x) AS width, max(y) - min(y) AS extent, median(rate) AS rate, count(*) AS n FROM s GROUP BY track)
SELECT track, round(width, 4) AS width, round(rate, 5) AS rate, CASE WHEN n < 20 THEN 'short' WHEN rate > 4 THEN 'fast' WHEN width >= 40 AND extent > 80 THEN 'broad' ELSE 'line' END AS quality FROM g""")
def q82(spark, d):
    rate = F.abs(F.col("y") - F.lag("y").over(w())) / F.nullif((F.col("t") - F.lag("t").over(w())) / 3600, F.lit(0.0))
    g = observations(spark, d).withColumn("rate", rate).groupBy("track").agg(F.percentile("x", F.lit(0.5)).alias("width"), (F.max("y") - F.min("y")).alias("extent"), F.percentile("rate", F.lit(0.5)).alias("rate"), F.count("*").alias("n"))
    return g.select("track", r("width").alias("width"), r("rate", 5).alias("rate"), F.when(F.col("n") < 20, "short").when(F.col("rate") > 4, "fast").when((F.col("width") >= 40) & (F.col("extent") > 80), "broad").otherwise("line").alias("quality"))


MASK = """e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) > 0 AS bit, generate_subscripts(embedding, 1) AS i, label FROM embeddings), p AS (SELECT label, i, median(CASE WHEN bit THEN 1 ELSE 0 END) >= 0.5 AS bit FROM e GROUP BY label, i),
s AS (SELECT e.vec_id, p.label, CAST(sum(CASE WHEN p.bit THEN 1 ELSE 0 END) AS DOUBLE) AS total, CAST(sum(CASE WHEN p.bit AND e.bit THEN 1 ELSE 0 END) AS DOUBLE) AS hit, CAST(sum(CASE WHEN e.bit THEN 1 ELSE 0 END) AS DOUBLE) AS seen FROM e JOIN p USING (i) GROUP BY e.vec_id, p.label),
k AS (SELECT vec_id, label, round((total - hit + 0.6 * greatest(0, seen - hit)) / greatest(1, total + 0.6 * seen), 9) AS err FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY err, label) AS j FROM k)"""


@query("q83_masked_template_margin", f"WITH {MASK} SELECT vec_id, max(label) FILTER (j = 1) AS best, round(max(err) FILTER (j = 1), 6) AS err, round(max(err) FILTER (j = 2) - max(err) FILTER (j = 1), 6) AS margin FROM o GROUP BY vec_id")
def q83(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v > 0).alias("bits"))
    n = F.posexplode("bits").alias("i", "bit")
    proto = e.select("label", n).groupBy("label", "i").agg((F.percentile(F.col("bit").cast("int"), F.lit(0.5)) >= 0.5).alias("bit"))
    bank = proto.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "bit"))), lambda x: x["bit"]).alias("mask"))
    ones = lambda a: F.size(F.filter(a, lambda b: b)).cast("double")
    hit = F.size(F.filter(F.zip_with("bits", "mask", lambda a, b: a & b), lambda b: b)).cast("double")
    err = r((ones("mask") - hit + 0.6 * F.greatest(F.lit(0.0), ones("bits") - hit)) / F.greatest(F.lit(1.0), ones("mask") + 0.6 * ones("bits")), 9)
    # a bank of one row a label against every vector, in passes of so many labels
    found = [best_two(e.select("vec_id", "bits").crossJoin(part).withColumn("err", err), 9) for part in passes(held(bank))]
    g = best_two(reduce(DataFrame.unionByName, found), 9).groupBy("vec_id")
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    return g.agg(pick(1, "label").alias("best"), r(pick(1, "err"), 6).alias("err"), r(pick(2, "err") - pick(1, "err"), 6).alias("margin"))


@query("q84_median_filter5", f"""
WITH {OBS}, k AS (SELECT track, id, x, lag(x, 2) OVER q AS a, lag(x) OVER q AS b, lead(x) OVER q AS c, lead(x, 2) OVER q AS e, first_value(x) OVER z AS f, last_value(x) OVER z AS l FROM obs WINDOW q AS (PARTITION BY track ORDER BY t, id), z AS (PARTITION BY track ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT track, id, list_sort([coalesce(a, f), coalesce(b, f), x, coalesce(c, l), coalesce(e, l)])[3] AS filtered FROM k""")
def q84(spark, d):
    return ordered.median_filter(observations(spark, d), ["track"], ["t", "id"], "x", 2).select("track", "id", "filtered")


SPEED = "s AS (SELECT *, (y - lag(y) OVER q) / nullif((t - lag(t) OVER q) / 3600, 0) AS v FROM obs WINDOW q AS (PARTITION BY track ORDER BY t, id))"


def _speed(spark, d):
    return observations(spark, d).withColumn("v", (F.col("y") - F.lag("y").over(w())) / F.nullif((F.col("t") - F.lag("t").over(w())) / 3600, F.lit(0.0)))


@query("q85_deceleration_onset", f"""
WITH {OBS}, {SPEED}, m AS (SELECT *, median(v) OVER (PARTITION BY track ORDER BY t, id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS prior FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY t, id) AS j FROM m WHERE abs(v) < 2 AND prior > 1)
SELECT track, id, round(v, 5) AS v, round(prior, 5) AS prior FROM k WHERE j = 1""")
def q85(spark, d):
    return motion.deceleration(_speed(spark, d), ["track"], ["t", "id"], "v", 2.0, 1.0).select("track", "id", r("v", 5).alias("v"), r("prior", 5).alias("prior"))


@query("q86_settled_deceleration", f"""
WITH {OBS}, {SPEED}, m AS (SELECT *, median(v) OVER (PARTITION BY track ORDER BY t, id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS prior, median(v) OVER (PARTITION BY track ORDER BY t, id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS later FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY t, id) AS j FROM m WHERE abs(v) < 4 AND prior > 1 AND abs(later) < 1) SELECT track, id, round(prior, 5) AS prior FROM k WHERE j = 1""")
def q86(spark, d):
    return motion.deceleration(_speed(spark, d), ["track"], ["t", "id"], "v", 4.0, 1.0, 1.0).select("track", "id", r("prior", 5).alias("prior"))


@query("q87_stable_ends", f"""
WITH {OBS}, a AS (SELECT track, id, t, x - 25 AS dx, y - 50 AS dy FROM obs), p AS (SELECT *, CASE WHEN dx * lag(dx) OVER q + dy * lag(dy) OVER q < 0 THEN 1 ELSE 0 END AS neg FROM a {Q})
SELECT track, id, sum(neg) OVER (PARTITION BY track ORDER BY t, id ROWS UNBOUNDED PRECEDING) % 2 = 1 AS swapped FROM p""")
def q87(spark, d):
    a = observations(spark, d).withColumn("dx", F.col("x") - 25).withColumn("dy", F.col("y") - 50)
    return motion.stable_ends(a, ["track"], ["t", "id"], "dx", "dy").select("track", "id", "swapped")


@query("q88_predicted_mean", f"""
WITH {OBS}, l AS (SELECT track, list({{'id': id, 's': CAST(x AS DOUBLE)}} ORDER BY t, id) AS v FROM obs GROUP BY track),
f AS (SELECT track, list_reduce(list_transform(v, lambda e: [e]), lambda acc, e: list_append(acc, {{'id': e[1].id, 's': 0.6 * e[1].s + (1 - 0.6) * acc[len(acc)].s}})) AS k FROM l)
SELECT track, u.id AS id, round(u.s, 4) AS smoothed FROM (SELECT track, unnest(k) AS u FROM f)""")
def q88(spark, d):
    return motion.smooth(observations(spark, d), ["track"], ["t", "id"], "x").select("track", "id", r("smoothed").alias("smoothed"))


@query("q89_teleport_limit", f"""
WITH {OBS}, l AS (SELECT track, list({{'t': t, 'id': id, 'y': y}} ORDER BY t, id) AS v FROM obs GROUP BY track),
f AS (SELECT track, list_reduce(list_transform(v, lambda e: [e]), lambda acc, e: CASE WHEN abs(e[1].y - acc[len(acc)].y) > greatest(30, (e[1].t - acc[len(acc)].t) / 3600 * 0.5) THEN acc ELSE list_concat(acc, e) END) AS k FROM l)
SELECT track, u.id AS id, u.y AS y FROM (SELECT track, unnest(k) AS u FROM f)""")
def q89(spark, d):
    step = lambda a, e: F.abs(e["y"] - a["y"]) <= F.greatest(F.lit(30.0), (e["t"] - a["t"]) / 3600 * 0.5)
    return greedy.monotone(observations(spark, d), ["track"], ["t", "id"], ["y"], step).select("track", "id", "y")


@query("q90_tail_collapse", f"""
WITH {OBS}, m AS (SELECT *, max(t) OVER (PARTITION BY track) AS e, -(y - lag(y) OVER q) / nullif((t - lag(t) OVER q) / 3600, 0) AS rate FROM obs {Q}), n AS (SELECT * FROM m WHERE t >= e - 259200),
g AS (SELECT track, median(rate) AS rate, count(*) AS n, max(e) AS e, last(y ORDER BY t, id) AS y FROM n GROUP BY track)
SELECT track, n, round(rate, 5) AS rate, round(e + least(36, y / rate) * 3600, 2) AS finish FROM g WHERE n >= 3 AND rate > 0.1 AND rate < 30""")
def q90(spark, d):
    o = observations(spark, d).withColumn("h", F.col("t") / 3600)
    # hours since 1970 lose digits in differences of a quotient, so rates come from seconds
    g = motion.tail_collapse(o, ["track"], "t", "id", "y", 3 * DAY, 0.1 / 3600, 30 / 3600, 36 * HOUR)
    return g.select("track", "n", r(F.col("rate") * 3600, 5).alias("rate"), r("finish", 2).alias("finish"))


@query("q91_level_crossing", f"""
WITH {OBS}, s AS (SELECT *, lead(t) OVER q AS t1, lead(y) OVER q AS y1 FROM obs {Q})
SELECT track, round(min(t + (50 - y) * (t1 - t) / greatest(1e-6, y1 - y)), 2) AS contact FROM s WHERE t1 > t AND y <= 50 AND y1 >= 50 GROUP BY track""")
def q91(spark, d):
    return motion.crossing(observations(spark, d), ["track"], "t", "id", "y", 50.0).select("track", r("contact", 2).alias("contact"))
