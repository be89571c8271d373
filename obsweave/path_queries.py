"""Queries on evidence, paths, release checks, sets and codecs, with the DuckDB SQL that gives the same rows."""
from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import scalar
from .functions.scalar import clip
from .operators import greedy, joins, paths
from .queries import DAY, HOLDS, HOUR, OBS, query, r, w
from .sources.shared import held
from .sources.tables import fingerprint, holds, observations, table, unfinished

KEY = "ok, ln, pk, round(price, 2) AS price"


def _key():
    return "ok", "ln", "pk", r("price", 2).alias("price")


EVIDENCE = "SELECT *, ring >= 0.055 OR head >= 0.045 OR ring * head >= 0.003 OR (pk % 3 = 0 AND duration > 0) AS supported, pk % 5 = 0 AS faint, pk % 11 = 0 AS never FROM holds"


def _evidence(spark, d):
    h = holds(spark, d).withColumn("supported", scalar.supported(F.col("ring"), F.col("head"), F.col("ring") * F.col("head"), F.expr("pk % 3 = 0"), F.expr("duration > 0"), 0.055, 0.045, 0.003))
    return h.withColumn("faint", F.expr("pk % 5 = 0")).withColumn("never", F.expr("pk % 11 = 0"))


@query("q92_evidence_predicates", f"WITH {HOLDS}, e AS ({EVIDENCE}) SELECT {KEY}, supported, faint AND NOT supported AND pk % 3 <> 0 AS weak, supported AND fake AND NOT never AS promotable FROM e")
def q92(spark, d):
    e = _evidence(spark, d)
    return e.select(*_key(), "supported", F.expr("faint AND NOT supported AND pk % 3 <> 0").alias("weak"), F.expr("supported AND fake AND NOT never").alias("promotable"))


@query("q93_solver_quality", f"""
WITH {HOLDS} SELECT {KEY}, round(0.4 * ln(1 + frames) + 1.5 * (pk % 3 = 0)::INT + least(6, 6 * ring) + least(5, 6 * head) + least(7, 10 * ring * head) + 0.8 * (frames >= 20)::INT - 3.5 * (ring = 0)::INT - 4 * (frames = 0)::INT + 0.25 * (NOT fake)::INT + 80 * (pk % 97 = 0)::INT, 5)::DOUBLE AS quality FROM holds""")
def q93(spark, d):
    q = scalar.solver_quality(F.col("frames"), F.expr("pk % 3 = 0"), F.col("ring"), F.col("head"), F.col("ring") * F.col("head"), F.expr("frames >= 20"), F.col("fake"), F.expr("pk % 97 = 0"))
    return holds(spark, d).select(*_key(), r(q, 5).alias("quality"))


@query("q94_block_rules", f"""
WITH {HOLDS}, e AS ({EVIDENCE}), s AS (SELECT ok AS sok, pk AS spk, t AS st FROM holds WHERE ring >= 0.09), u AS (SELECT ok AS uok, pk AS upk, t AS ut, frames AS uf FROM holds WHERE ring >= 0.06),
b AS (SELECT *, pk % 97 = 0 AS required, pk % 17 = 0 AS deferred, pk % 7 = 0 AS wide, EXISTS (SELECT 1 FROM s WHERE s.spk = e.pk AND s.sok <> e.ok AND abs(s.st - e.t) < 950400) AS twin, EXISTS (SELECT 1 FROM u WHERE u.upk = e.pk AND u.uok <> e.ok AND abs(u.ut - e.t) < 2592000 AND abs(u.uf - e.frames) <= 3) AS copy FROM e),
k AS (SELECT *, (CASE WHEN frames >= 30 THEN false ELSE (faint AND ring < 0.025) OR (wide AND head < 0.01 AND ring < 0.04) END) OR (ring < 0.02 AND twin) OR (ring < 0.06 AND copy) OR (duration > 1728000 AND frames < 8 AND ring < 0.05) AS early FROM b)
SELECT {KEY}, CASE WHEN pk % 13 = 0 AND NOT required THEN true WHEN required THEN false ELSE (CASE WHEN deferred THEN true ELSE early END) OR (never AND NOT supported) END AS blocked FROM k""")
def q94(spark, d):
    e = _evidence(spark, d).withColumn("row", F.monotonically_increasing_id()).withColumns({"required": F.expr("pk % 97 = 0"), "deferred": F.expr("pk % 17 = 0"), "wide": F.expr("pk % 7 = 0"), "visual": F.expr("pk % 13 = 0")})
    near = lambda rows, others, reach: joins.band_join(rows.select("row", "pk", "ok", "t", "frames"), others.select("pk", "ok", "t", "frames"), ["pk"], "t", -reach, reach).where((F.col("ok") != F.col("ok_r")) & (F.abs(F.col("t_r") - F.col("t")) < reach))
    flag = lambda found, name: found.select("row").distinct().withColumn(name, F.lit(True))
    twin = flag(near(e.where("ring < 0.02"), e.where("ring >= 0.09"), 11 * DAY), "twin")
    copy = flag(near(e.where("ring < 0.06"), e.where("ring >= 0.06"), 30 * DAY).where(F.abs(F.col("frames_r") - F.col("frames")) <= 3), "copy")
    b = e.join(twin, "row", "left").join(copy, "row", "left").fillna(False, ["twin", "copy"])
    return b.select(*_key(), scalar.blocked().alias("blocked"))


@query("q95_release_checks", f"""
WITH {HOLDS} SELECT count(*) FILTER (duration < 0) AS negative, count(*) FILTER (NOT isfinite(t) OR NOT isfinite(duration)) AS invalid, count(*) FILTER (frames < 1) AS frameless, CAST(sum(length(CAST(CAST(price AS BIGINT) AS VARCHAR)) + 1) AS BIGINT) AS payload, sum(length(CAST(CAST(price AS BIGINT) AS VARCHAR)) + 1) <= 1500000 AS fits FROM holds""")
def q95(spark, d):
    h = scalar.finite(holds(spark, d), "t", "duration")
    finite = lambda c: F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) & ~F.isnan(c)
    size = F.sum(F.length(F.col("price").cast("double").try_cast("decimal(20,2)").cast("decimal(20,0)").cast("string")) + 1)
    return h.agg(F.count_if(F.col("duration") < 0).alias("negative"), F.count_if(~finite("t") | ~finite("duration")).alias("invalid"), F.count_if(F.expr("frames < 1")).alias("frameless"), size.alias("payload"), (size <= 1_500_000).alias("fits"))


@query("q96_speed_clamp", f"""
WITH {HOLDS}, b AS (SELECT *, CAST(floor(t / 691200) AS BIGINT) AS seg FROM holds), m AS (SELECT seg, median(price) AS med FROM b GROUP BY seg), a AS (SELECT b.seg, median(abs(price - med)) AS mad FROM b JOIN m USING (seg) GROUP BY b.seg)
SELECT {KEY}, round(CASE WHEN frames < 6 OR abs(price - med) > greatest(180, 1.2 * mad) THEN med ELSE price END, 3) AS speed, round(CASE WHEN frames < 6 OR abs(price - med) > greatest(180, 1.2 * mad) THEN duration * price / med ELSE duration END, 1) AS lasting FROM b JOIN m USING (seg) JOIN a USING (seg)""")
def q96(spark, d):
    b = holds(spark, d).withColumn("seg", F.floor(F.col("t") / 691200))
    m = b.groupBy("seg").agg(F.percentile("price", F.lit(0.5)).alias("med"))
    a = b.join(m, "seg").groupBy("seg").agg(F.percentile(F.abs(F.col("price") - F.col("med")), F.lit(0.5)).alias("mad"), F.first("med").alias("med"))
    out = F.expr("frames < 6 OR abs(price - med) > greatest(180, 1.2D * mad)")
    return b.join(a, "seg").select(*_key(), r(F.when(out, F.col("med")).otherwise(F.col("price")), 3).alias("speed"), r(F.when(out, F.col("duration") * F.col("price") / F.col("med")).otherwise(F.col("duration")), 1).alias("lasting"))


@query("q97_chart_coordinates", f"""
WITH {OBS}, c AS (SELECT id, (x - 640) / 1280 * 1920 AS cx, (y * 7.2 - 360) / 720 * 1080 AS cy, radians(y * 3.6) AS a FROM obs)
SELECT id, round(cx, 4) AS cx, round(cy, 4) AS cy, round(cx * cos(a) + cy * sin(a), 4) AS lx, round(cy * cos(a) - cx * sin(a), 4) AS ly, round(least(greatest(cx / (2000 * 0.0223 * (335 / 185) * 0.54), -1.3), 1.3), 5) AS scale FROM c""")
def q97(spark, d):
    o = observations(spark, d)
    cx, cy = scalar.chart_point(F.col("x"), F.col("y") * 7.2)
    lx, ly = scalar.rotated(F.col("cx"), F.col("cy"), F.radians(F.col("y") * 3.6))
    return o.withColumn("cx", cx).withColumn("cy", cy).select("id", r("cx").alias("cx"), r("cy").alias("cy"), r(lx).alias("lx"), r(ly).alias("ly"), r(clip(F.col("cx") / (2000 * 0.0223 * (335 / 185) * 0.54), -1.3, 1.3), 5).alias("scale"))


@query("q98_line_clip", f"""
WITH {OBS}, l AS (SELECT id, radians(y * 1.8 + 0.7) AS th, x * 4 AS rho FROM obs),
p AS (SELECT id, list_filter([{{'x': 0.0, 'y': rho / sin(th)}}, {{'x': 1280.0, 'y': (rho - 1280 * cos(th)) / sin(th)}}, {{'x': rho / cos(th), 'y': 0.0}}, {{'x': (rho - 720 * sin(th)) / cos(th), 'y': 720.0}}], lambda e: e.x >= 0 AND e.x <= 1280 AND e.y >= 0 AND e.y <= 720) AS v FROM l)
SELECT id, len(v) AS ends, round(sqrt((v[1].x - v[len(v)].x) * (v[1].x - v[len(v)].x) + (v[1].y - v[len(v)].y) * (v[1].y - v[len(v)].y)), 3) AS length FROM p WHERE len(v) >= 2""")
def q98(spark, d):
    l = observations(spark, d).select("id", scalar.line_ends(F.radians(F.col("y") * 1.8 + 0.7), F.col("x") * 4, 1280.0, 720.0).alias("v")).where(F.size("v") >= 2)  # noqa: E741
    a, b = F.col("v")[0], F.element_at("v", -1)
    return l.select("id", F.size("v").cast("long").alias("ends"), r(F.hypot(a["x"] - b["x"], a["y"] - b["y"]), 3).alias("length"))


@query("q99_thin_holds", f"""
WITH {HOLDS}, p AS (SELECT pk, median(ring) AS fill FROM holds GROUP BY pk) SELECT {KEY}, CASE WHEN duration > 0 AND fill < 0.045 THEN 0 ELSE duration END AS lasting, CASE WHEN duration > 0 AND fill < 0.045 THEN (head >= 0.04)::INT ELSE 2 END AS kind, ring < 0.01 AND frames <= 3 AS fragment FROM holds JOIN p USING (pk)""")
def q99(spark, d):
    h = holds(spark, d)
    p = h.groupBy("pk").agg(F.percentile("ring", F.lit(0.5)).alias("fill"))
    thin = F.expr("duration > 0 AND fill < 0.045D")
    return h.join(p, "pk").select(*_key(), F.when(thin, 0.0).otherwise(F.col("duration")).alias("lasting"), F.when(thin, (F.col("head") >= 0.04).cast("int")).otherwise(2).alias("kind"), F.expr("ring < 0.01D AND frames <= 3").alias("fragment"))


PATHS = "pt AS (SELECT track, list({'t': t, 'x': CAST(x AS DOUBLE), 'y': CAST(y AS DOUBLE)} ORDER BY t, id) AS p FROM obs GROUP BY track)"


def _paths(spark, d):
    o = observations(spark, d)
    v = F.array_sort(F.collect_list(F.struct("t", "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))))
    return o.groupBy("track").agg(F.transform(v, lambda e: F.struct(e["t"].alias("t"), e["x"].alias("x"), e["y"].alias("y"))).alias("p"))


@query("q100_approach_extension", f"""
WITH {OBS}, {PATHS}, s AS (SELECT track, p, p[1] AS a, p[least(4, len(p))] AS b, list_median(list_filter([p[i + 1].t - p[i].t FOR i IN range(1, least(5, len(p)))], lambda z: z > 1e-4)) AS step FROM pt),
v AS (SELECT *, (b.x - a.x) / (b.t - a.t) AS vx, (b.y - a.y) / (b.t - a.t) AS vy FROM s)
SELECT track, CAST(len(p) AS INTEGER) AS n, round(CASE WHEN len(p) >= 3 AND b.t - a.t > 36 AND p[len(p)].t - a.t >= greatest(28800, least(43200, 3 * step)) AND vy > 0.00001 AND a.y < 90 THEN a.t - least(least(270000, (a.y + 28) / vy), a.t) ELSE a.t END, 1) AS first FROM v""")
def q100(spark, d):
    p = paths.extended(_paths(spark, d), "p", F.element_at("p", -1)["t"], 36.0, 8 * HOUR, 12 * HOUR, 0.00001, 90.0, 28.0, 75 * HOUR)
    return p.select("track", F.size("p").alias("n"), r(F.col("start")["t"], 1).alias("first"))


@query("q101_visibility_envelope", f"""
WITH {HOLDS}, e AS (SELECT ok, ln, pk, price, t, CASE WHEN ring = 0 AND NOT fake AND head > 0.06 THEN 0.02 ELSE 0.6 END AS lead, duration FROM holds), k AS (SELECT *, unnest([t - lead - 0.00001, t - lead, t, t + duration, t + duration + 0.00001]) AS moment, unnest([0, 1, 2, 3, 4]) AS place, unnest([0.0, 0.5, 1.0, 0.5, 0.0]) AS alpha FROM e)
SELECT ok, ln, pk, round(price, 2) AS price, CAST(place AS INTEGER) AS place, round(moment, 5) AS moment, CAST(alpha AS DOUBLE) AS alpha FROM k""")
def q101(spark, d):
    h = holds(spark, d)
    lead = scalar.fallback_lead(F.expr("ring = 0 AND head > 0.06D"), F.col("fake"))
    return paths.envelope(h, F.col("t") - lead, F.col("t"), F.col("t") + F.col("duration")).select(*_key(), "place", r("at", 5).alias("moment"), "alpha")


@query("q102_flow_from_length", f"""
WITH {OBS}, m AS (SELECT *, max(t) OVER (PARTITION BY track) AS e FROM obs) SELECT track, id, round(x / (greatest(54, e - greatest(t, e - 864000)) / 3600 * 120 * 1.66), 6) AS flow FROM m""")
def q102(spark, d):
    end = F.max("t").over(Window.partitionBy("track"))
    o = observations(spark, d).withColumn("e", end)
    left = F.greatest(F.lit(54.0), F.col("e") - F.greatest(F.col("t"), F.col("e") - 10 * DAY)) / 3600
    return o.select("track", "id", r(F.col("x") / (left * 120 * 1.66), 6).alias("flow"))


@query("q103_anchor_override", f"""
WITH {OBS}, h AS (SELECT track, max(t) AS moment FROM obs WHERE kind = 'purchase' GROUP BY track), k AS (SELECT o.track, o.t, o.x, o.y FROM obs o LEFT JOIN h USING (track) WHERE h.moment IS NULL OR abs(o.t - h.moment) > 3600 UNION ALL SELECT track, moment, 50, 50 FROM h)
SELECT track, CAST(row_number() OVER (PARTITION BY track ORDER BY t, x, y) AS INTEGER) AS place, round(t, 3) AS t, CAST(x AS DOUBLE) AS x, CAST(y AS INTEGER) AS y FROM k""")
def q103(spark, d):
    o = observations(spark, d)
    h = o.where("kind = 'purchase'").groupBy("track").agg(F.max("t").alias("at"))
    k = o.join(h, "track", "left").where((F.col("at").isNull()) | (F.abs(F.col("t") - F.col("at")) > HOUR)).select("track", "t", "x", "y")
    k = k.union(h.select("track", "at", F.lit(50.0), F.lit(50)))
    return k.select("track", F.row_number().over(Window.partitionBy("track").orderBy("t", "x", "y")).alias("place"), r("t", 3).alias("t"), F.col("x").cast("double").alias("x"), F.col("y").cast("int").alias("y"))


@query("q104_axis_angles", f"""
WITH {OBS}, a AS (SELECT track, id, t, degrees(atan2(y - 50, x - 25)) AS deg FROM obs), s AS (SELECT *, coalesce(((((deg - lag(deg) OVER q) + 180) % 360) + 360) % 360 - 180, 0) AS st FROM a WINDOW q AS (PARTITION BY track ORDER BY t, id)),
u AS (SELECT *, first_value(deg) OVER (PARTITION BY track ORDER BY t, id) + sum(st) OVER (PARTITION BY track ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS v FROM s),
m AS (SELECT *, list_sort([coalesce(lag(v) OVER q, v), v, coalesce(lead(v) OVER q, v)])[2] AS f FROM u WINDOW q AS (PARTITION BY track ORDER BY t, id))
SELECT track, id, round(CASE WHEN abs(f - 90) < 4 THEN 90 ELSE f END, 3)::DOUBLE + 0.0::DOUBLE AS angle FROM m""")
def q104(spark, d):
    a = observations(spark, d).withColumn("deg", F.degrees(F.atan2(F.col("y") - 50, F.col("x") - 25)))
    return paths.axis_angles(a, ["track"], ["t", "id"], "deg", 4.0).select("track", "id", (r(F.col("angle").cast("double"), 3) + F.lit(0.0)).alias("angle"))


@query("q105_split_votes", f"""
WITH {HOLDS}, v AS (SELECT pk, median(frames) AS gap, count(*) FILTER (ring > 0.05) AS votes FROM holds GROUP BY pk), s AS (SELECT h.*, gap, gap BETWEEN 20 AND 30 AND votes >= 3 AS two FROM holds h JOIN v USING (pk))
SELECT {KEY}, 0 AS part, round(CASE WHEN two THEN t - gap * 3600 ELSE t END, 1) AS moment FROM s UNION ALL SELECT {KEY}, 1, round(t + gap * 3600, 1) FROM s WHERE two""")
def q105(spark, d):
    from .operators.motion import split_pairs

    h = holds(spark, d)
    v = h.groupBy("pk").agg(F.percentile("frames", F.lit(0.5)).alias("gap"), F.count_if(F.expr("ring > 0.05D")).alias("votes"))
    s = h.join(v, "pk").withColumn("two", F.expr("gap BETWEEN 20 AND 30 AND votes >= 3"))
    at = F.when(F.col("two"), F.col("t") - F.col("gap") * 3600).otherwise(F.col("t"))
    return split_pairs(s, [F.lit(0), at], [F.lit(1), F.col("t") + F.col("gap") * 3600], ["part", "at"], F.col("two")).select(*_key(), "part", r("at", 1).alias("moment"))


@query("q106_budgeted_flips", f"""
WITH {HOLDS}, i AS (SELECT *, CAST(floor(t / 604800) AS BIGINT) AS week FROM holds), n AS (SELECT week, count(*) FILTER (NOT fake) - CAST(count(*) * 0.7 AS BIGINT) AS surplus FROM i GROUP BY week),
k AS (SELECT i.*, surplus, row_number() OVER (PARTITION BY week, fake ORDER BY CASE WHEN fake THEN -ring - head ELSE ring + head END, ok, ln, pk, price) AS k FROM i JOIN n USING (week))
SELECT {KEY}, CAST(week AS BIGINT) AS week, NOT fake AS now_fake FROM k WHERE (NOT fake AND k <= surplus) OR (fake AND k <= -surplus)""")
def q106(spark, d):
    i = holds(spark, d).withColumn("week", F.floor(F.col("t") / 604800))
    n = i.groupBy("week").agg((F.count_if(~F.col("fake")) - F.round(F.count("*") * F.lit(0.7).cast("decimal(3,1)")).cast("long")).alias("surplus"))
    score = F.when(F.col("fake"), -F.col("ring") - F.col("head")).otherwise(F.col("ring") + F.col("head"))
    k = greedy.ranked(i, ["week", "fake"], score, "ok", "ln", "pk", "price").join(n, "week")
    return k.where((~F.col("fake") & (F.col("rank") <= F.col("surplus"))) | (F.col("fake") & (F.col("rank") <= -F.col("surplus")))).select(*_key(), "week", (~F.col("fake")).alias("now_fake"))


@query("q107_merged_evidence", f"""
WITH {HOLDS}, c AS (SELECT pk, CAST(floor(t / 2592000) AS BIGINT) AS month, max(ring) AS ring, max(head) AS head, max(frames) AS frames, min(ok * 10 + ln) AS keeper, count(*) AS n FROM holds GROUP BY 1, 2) SELECT * FROM c WHERE n > 1""")
def q107(spark, d):
    h = holds(spark, d).withColumn("month", F.floor(F.col("t") / (30 * DAY)))
    return h.groupBy("pk", "month").agg(F.max("ring").alias("ring"), F.max("head").alias("head"), F.max("frames").alias("frames"), F.min(F.col("ok") * 10 + F.col("ln")).alias("keeper"), F.count("*").alias("n")).where("n > 1")


@query("q108_path_extension", f"""
WITH {OBS}, a AS (SELECT track, min(t) AS lo, max(t) AS hi FROM obs WHERE kind = 'view' GROUP BY track) SELECT o.track, o.id, o.kind = 'view' AS own FROM obs o JOIN a USING (track) WHERE o.kind = 'view' OR (o.kind = 'click' AND (o.t < a.lo OR o.t > a.hi))""")
def q108(spark, d):
    o = observations(spark, d)
    return paths.extend_ends(o.where("kind = 'view'"), o.where("kind = 'click'"), "track", "t").select("track", "id", "own")


@query("q109_two_predictors", f"""
WITH {OBS}, c AS (SELECT track, x - avg(x) OVER g AS z, y - avg(y) OVER g AS a, (t - avg(t) OVER g) / 86400 AS b FROM obs WINDOW g AS (PARTITION BY track)), s AS (SELECT track, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * z) AS az, sum(b * z) AS bz FROM c GROUP BY track)
SELECT track, round((az * bb - bz * ab) / (aa * bb - ab * ab), 4) AS by_y, round((bz * aa - az * ab) / (aa * bb - ab * ab), 4) AS by_t FROM s WHERE aa * bb - ab * ab > 1e-6""")
def q109(spark, d):
    return paths.two_predictors(observations(spark, d), "track", "x", F.col("y"), F.col("t"), 86400.0).select("track", r("b1").alias("by_y"), r("b2").alias("by_t"))


@query("q110_total_order", f"""
WITH {OBS}, u AS (SELECT t, 0 AS what, id FROM obs UNION ALL SELECT unnest(generate_series(1704067200, 1704067200 + 2591999, 3600))::DOUBLE, 1, 0) SELECT row_number() OVER (ORDER BY t, what, id) AS place, what, id FROM u""")
def q110(spark, d):
    o = observations(spark, d).select("t", F.lit(0).alias("what"), "id")
    ticks = spark.range(1704067200, 1704067200 + 2592000, 3600).select(F.col("id").cast("double").alias("t"), F.lit(1).alias("what"), F.lit(0).cast("long").alias("id"))
    return paths.numbered(o.union(ticks), ["t", "what", "id"]).select("place", "what", "id")


@query("q111_pack_equivalence", """WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem), b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 100 = 7 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity FROM lineitem)
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS missing, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS added""")
def q111(spark, d):
    a = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    b = a.withColumn("l_quantity", F.when(F.col("l_orderkey") % 100 == 7, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    return paths.difference(a, b)


@query("q112_interval_comparison", f"""
WITH {OBS}, i AS (SELECT track, min(t) AS lo, max(t) AS hi FROM obs WHERE kind = 'purchase' GROUP BY track) SELECT o.track, count(*) AS n, round(sum(abs(x - y)), 3) AS total, round(max(abs(x - y)), 3) AS worst FROM obs o JOIN i ON o.track = i.track AND o.t BETWEEN i.lo AND i.hi GROUP BY o.track""")
def q112(spark, d):
    o = observations(spark, d)
    i = o.where("kind = 'purchase'").groupBy("track").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    gap = F.abs(F.col("x") - F.col("y"))
    return o.join(i, "track").where("t BETWEEN lo AND hi").groupBy("track").agg(F.count("*").alias("n"), r(F.sum(gap), 3).alias("total"), r(F.max(gap), 3).alias("worst"))


@query("q113_batch_report", """
WITH f AS (SELECT o_orderkey AS run, o_orderstatus = 'F' AS ok FROM orders), s AS (SELECT run, row_number() OVER (ORDER BY run) AS place FROM f WHERE ok) SELECT run, 'done' AS state, place FROM s UNION ALL SELECT run, 'failed', CAST(0 AS BIGINT) FROM f WHERE NOT ok""")
def q113(spark, d):
    f = table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), (F.col("o_orderstatus") == "F").alias("ok"))
    done = f.where("ok").select("run")
    s = paths.numbered(done, ["run"]).select("run", F.lit("done").alias("state"), "place")
    return s.union(unfinished(f, done, "run").select("run", F.lit("failed"), F.lit(0).cast("long")))


@query("q114_reading_difference", f"""
WITH {OBS} SELECT a.track, a.id, CAST(a.y - b.y AS DOUBLE) AS difference FROM obs a LEFT JOIN (SELECT track, t, min(y) AS y FROM obs WHERE kind = 'view' GROUP BY track, t) b ON a.track = b.track AND a.t = b.t""")
def q114(spark, d):
    o = observations(spark, d)
    b = o.where("kind = 'view'").groupBy("track", "t").agg(F.min("y").alias("z"))
    return o.join(b, ["track", "t"], "left").select("track", "id", (F.col("y") - F.col("z")).cast("double").alias("difference"))


@query("q115_stage_manifest", """
WITH m AS (SELECT o_orderkey AS stage, sha256(concat_ws('|', CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority)) AS fingerprint, o_orderstatus <> 'P' AS complete FROM orders), w AS (SELECT o_orderkey AS stage, sha256(concat_ws('|', CAST(CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_custkey END AS VARCHAR), o_orderstatus, o_orderpriority)) AS fingerprint FROM orders)
SELECT stage FROM w WHERE EXISTS (SELECT 1 FROM m WHERE m.complete AND m.stage = w.stage AND m.fingerprint = w.fingerprint)""")
def q115(spark, d):
    from .sources.tables import reusable

    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "stage")
    manifest = o.select("stage", fingerprint("o_custkey", "o_orderstatus", "o_orderpriority").alias("fingerprint"), (F.col("o_orderstatus") != "P").alias("complete"))
    wanted = o.withColumn("o_custkey", F.when(F.col("stage") % 7 == 0, 0).otherwise(F.col("o_custkey"))).select("stage", fingerprint("o_custkey", "o_orderstatus", "o_orderpriority").alias("fingerprint"))
    return reusable(wanted, manifest).select("stage")


@query("q116_url_parts", r"""
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, url_decode(regexp_extract(url, '[?&]ref=([^&#]*)', 1)) AS ref, coalesce(TRY_CAST(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS INTEGER), 0) AS page, lpad(CAST(page_id AS VARCHAR), 6, '0') AS padded, CAST(len(string_split(url, '/')) AS INTEGER) AS parts FROM pages""")
def q116(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(u, "^[a-z]+://([^/?#]+)", 1).alias("host"), F.url_decode(F.regexp_extract(u, "[?&]ref=([^&#]*)", 1)).alias("ref"), F.coalesce(F.nullif(F.regexp_extract(u, "[?&]page=([0-9]+)", 1), F.lit("")).try_cast("int"), F.lit(0)).alias("page"), F.lpad(F.col("page_id").cast("string"), 6, "0").alias("padded"), F.size(F.split(u, "/")).alias("parts"))


@query("q117_byte_ranges", """
WITH s AS (SELECT doc_id, strlen(coalesce(text, '')) AS size, doc_id % 3 AS kind, doc_id * 37 % 5000 AS a FROM documents), q AS (SELECT *, CASE WHEN kind = 0 THEN a WHEN kind = 1 THEN greatest(0, size - a) ELSE a END AS lo, CASE WHEN kind = 0 THEN least(a + 499, size - 1) ELSE size - 1 END AS hi FROM s)
SELECT doc_id, CASE WHEN 0 <= lo AND lo <= hi THEN 206 ELSE 416 END AS status, CASE WHEN 0 <= lo AND lo <= hi THEN hi - lo + 1 ELSE 0 END AS bytes FROM q""")
def q117(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), (F.col("doc_id") * 37 % 5000).alias("a"), (F.col("doc_id") % 3).alias("kind"))
    start = F.when(F.col("kind") != 1, F.col("a"))
    end = F.when(F.col("kind") == 0, F.col("a") + 499).when(F.col("kind") == 1, F.col("a"))
    s = s.withColumn("r", scalar.byte_range(F.col("size"), start, end))
    return s.select("doc_id", "r.status", F.when(F.col("r.status") == 206, F.col("r.last") - F.col("r.first") + 1).otherwise(0).alias("bytes"))


@query("q118_cross_column_codec", """
WITH q AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS a, CAST(round(l_extendedprice) AS BIGINT) AS b, l_partkey, l_suppkey, l_extendedprice FROM lineitem), p AS (SELECT k, n, a - coalesce(lag(b) OVER o, 0) AS da, b - a AS db FROM q WINDOW o AS (PARTITION BY k ORDER BY n, l_partkey, l_suppkey, l_extendedprice, a))
SELECT k, n, CASE WHEN da >= 0 THEN 2 * da ELSE -2 * da - 1 END AS za, CASE WHEN db >= 0 THEN 2 * db ELSE -2 * db - 1 END AS zb FROM p""")
def q118(spark, d):
    q = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("long").alias("a"), F.round("l_extendedprice").cast("long").alias("b"), "l_partkey", "l_suppkey", "l_extendedprice")
    o = Window.partitionBy("k").orderBy("n", "l_partkey", "l_suppkey", "l_extendedprice", "a")
    # a segment starts where the one before ended, and ends near its own start
    return q.select("k", "n", scalar.zigzag(F.col("a") - F.coalesce(F.lag("b").over(o), F.lit(0))).alias("za"), scalar.zigzag(F.col("b") - F.col("a")).alias("zb"))


@query("q119_counter_merge", """
WITH k AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), a AS (SELECT * FROM k WHERE event_type IN ('view', 'click')), b AS (SELECT user_id, event_type, n FROM k WHERE event_type IN ('click', 'purchase')),
m AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.n, 0) + coalesce(b.n, 0) AS added, coalesce(a.n, 0) - coalesce(b.n, 0) AS taken FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type)
SELECT user_id, event_type, added, taken FROM m""")
def q119(spark, d):
    k = table(spark, d, "events").groupBy("user_id", "event_type").count()
    of = lambda names: F.map_from_entries(F.collect_list(F.when(F.col("event_type").isin(names), F.struct("event_type", "count"))))
    m = k.groupBy("user_id").agg(of(["view", "click"]).alias("a"), of(["click", "purchase"]).alias("b"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    both = F.map_zip_with("a", "b", lambda key, x, y: F.struct((zero(x) + zero(y)).alias("added"), (zero(x) - zero(y)).alias("taken")))
    return m.select("user_id", F.explode(both).alias("event_type", "v")).select("user_id", "event_type", "v.added", "v.taken")


@query("q120_background", "WITH e AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT label, i, round(quantile_cont(v, 0.03), 5) AS background FROM e GROUP BY label, i")
def q120(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v")).withColumn("i", F.col("i").cast("long") + 1)
    return e.groupBy("label", "i").agg(r(F.percentile(F.col("v").cast("double"), F.lit(0.03)), 5).alias("background"))


@query("q121_tolerant_difference", f"""
WITH {OBS}, a AS (SELECT DISTINCT CAST(floor(t / 86400) AS BIGINT) AS frame, CAST(floor(x) AS BIGINT) AS px, y AS py FROM obs WHERE kind = 'view'), b AS (SELECT DISTINCT CAST(floor(t / 86400) AS BIGINT) AS frame, CAST(floor(x) AS BIGINT) AS px, y AS py FROM obs WHERE kind = 'click')
SELECT frame, count(*) AS missing FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.frame = a.frame AND abs(b.px - a.px) <= 4 AND abs(b.py - a.py) <= 4) GROUP BY frame""")
def q121(spark, d):
    o = observations(spark, d).select(F.floor(F.col("t") / DAY).alias("frame"), F.floor("x").alias("px"), F.col("y").alias("py"), "kind").distinct()
    a, b = (o.where(f"kind = '{k}'").drop("kind") for k in ("view", "click"))
    return joins.tolerant_anti(a, b, ["frame"], ["px", "py"], 4).groupBy("frame").agg(F.count("*").alias("missing"))


@query("q122_glyph_split", f"""
WITH {OBS}, c AS (SELECT DISTINCT track, y AS col FROM obs), g AS (SELECT *, col - row_number() OVER (PARTITION BY track ORDER BY col) AS k FROM c), s AS (SELECT track, min(col) AS lo, max(col) AS hi FROM g GROUP BY track, k) SELECT track, lo, hi FROM s WHERE hi - lo >= 1""")
def q122(spark, d):
    c = observations(spark, d).select("track", F.col("y").alias("col")).distinct()
    g = c.withColumn("k", F.col("col") - F.row_number().over(Window.partitionBy("track").orderBy("col")))
    return g.groupBy("track", "k").agg(F.min("col").alias("lo"), F.max("col").alias("hi")).where("hi - lo >= 1").select("track", "lo", "hi")


@query("q123_reading_lines", r"""
WITH l AS (SELECT conv_id, turn, unnest(string_split_regex(text, '[ \t\n]+')) AS word FROM conversations), k AS (SELECT conv_id, turn, word, regexp_full_match(word, '[0-9]+') AS digits FROM l WHERE word <> '') SELECT conv_id, turn, count(*) AS words, count(*) FILTER (digits) AS numbers, CAST(min(length(word)) AS INTEGER) AS least, count(*) FILTER (digits AND length(word) = 4) AS accepted FROM k GROUP BY conv_id, turn""")
def q123(spark, d):
    l = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split("text", "[ \t\n]+")).alias("word")).where("word <> ''")  # noqa: E741
    digits = F.col("word").rlike("^[0-9]+$")
    return l.groupBy("conv_id", "turn").agg(F.count("*").alias("words"), F.count_if(digits).alias("numbers"), F.min(F.length("word")).alias("least"), F.count_if(digits & (F.length("word") == 4)).alias("accepted"))


@query("q124_hough_lines", f"""
WITH {OBS}, p AS (SELECT DISTINCT CAST(floor(x) AS BIGINT) AS px, y AS py FROM obs), a AS (SELECT unnest(generate_series(0, 89)) AS th), h AS (SELECT th, CAST(round_even(round(px * cos(th * 2 * {math.pi!r} / 180) + py * sin(th * 2 * {math.pi!r} / 180), 6), 0) AS BIGINT) AS rho, count(*) AS n FROM p, a GROUP BY 1, 2),
m AS (SELECT h.*, (SELECT max(g.n) FROM h g WHERE abs(g.th - h.th) <= 1 AND abs(g.rho - h.rho) <= 1) AS top FROM h WHERE n > 20) SELECT th, rho, n FROM m WHERE n = top""")
def q124(spark, d):
    p = observations(spark, d).select(F.floor("x").alias("px"), F.col("y").alias("py")).distinct()
    return paths.hough(p, 90, 20).select("th", "rho", "n")


@query("q146_connected_parts", f"""
WITH RECURSIVE {OBS}, p AS (SELECT DISTINCT CAST(floor(t / 86400) AS BIGINT) AS frame, CAST(floor(x) AS BIGINT) AS px, CAST(y AS BIGINT) AS py FROM obs),
e AS (SELECT a.frame, a.py * 100000 + a.px AS a, b.py * 100000 + b.px AS b FROM p a JOIN p b ON a.frame = b.frame AND abs(a.px - b.px) + abs(a.py - b.py) = 1),
w AS (SELECT frame, py * 100000 + px AS a, py * 100000 + px AS b FROM p UNION SELECT w.frame, w.a, e.b FROM w JOIN e ON w.frame = e.frame AND w.b = e.a), m AS (SELECT frame, a, min(b) AS part FROM w GROUP BY frame, a)
SELECT p.frame, min(px) AS "left", max(px) AS "right", min(py) AS top, max(py) AS bottom, count(*) AS area FROM p JOIN m ON p.frame = m.frame AND p.py * 100000 + p.px = m.a GROUP BY p.frame, part""")
def q146(spark, d):
    from .operators import parts

    o = observations(spark, d).select(F.floor(F.col("t") / DAY).alias("frame"), F.floor("x").alias("px"), F.col("y").alias("py"))
    p = parts.parts(parts.runs_of_points(o, ["frame"], "px", "py"), ["frame"])
    return p.select("frame", "left", "right", "top", "bottom", "area")


@query("q147_many_predictors", f"""
WITH {OBS}, o AS (SELECT kind, x AS v, (t - 1704067200) / 86400 AS z, y % 10 AS c FROM obs), m AS (SELECT kind, c, avg(v) AS mv, avg(z) AS mz FROM o GROUP BY kind, c),
b AS (SELECT o.kind, sum((z - mz) * (v - mv)) / sum((z - mz) * (z - mz)) AS b FROM o JOIN m USING (kind, c) GROUP BY o.kind)
SELECT kind, CAST(0 AS BIGINT) AS i, round(b, 5) + 0 AS b FROM b UNION ALL SELECT m.kind, CAST(c AS BIGINT) + 1, round(mv - b * mz, 5) + 0 FROM m JOIN b USING (kind)""")
def q147(spark, d):
    from .operators.regress import least_squares

    o = observations(spark, d)
    xs = [(F.col("t") - 1704067200) / DAY, *((F.col("y") % 10 == c).cast("double") for c in range(10))]
    return least_squares(o, ["kind"], F.col("x"), xs).select("kind", "i", (r("b", 5) + 0.0).alias("b"))


def _huber(rounds: int, bound: float) -> str:
    """Lines by rounds of weighted sums, one common table expression a round."""
    out = ["m AS (SELECT track, avg(t) AS m FROM o GROUP BY track)", "r AS MATERIALIZED (SELECT o.track, t - m AS d, x AS v FROM o JOIN m USING (track))"]
    for k in range(rounds + 1):
        weight = "1.0" if not k else f"CASE WHEN abs(v - level - slope * d) <= {bound} THEN 1.0 ELSE {bound} / abs(v - level - slope * d) END"
        rows = f"SELECT r.track, d, v, {weight} AS w FROM r" + (f" JOIN l{k - 1} USING (track)" if k else "")
        sums = f"SELECT track, sum(w) AS n, sum(w * d) AS sd, sum(w * v) AS sv, sum(w * d * d) AS dd, sum(w * d * v) AS dv FROM ({rows}) GROUP BY track"
        slope = "(n * dv - sd * sv) / (n * dd - sd * sd)"
        out.append(f"l{k} AS MATERIALIZED (SELECT track, {slope} AS slope, (sv - {slope} * sd) / n AS level FROM ({sums}) WHERE n * dd - sd * sd > 1e-9 * n * n)")
    return ", ".join(out) + f" SELECT track, round(any_value(slope), 5) + 0 AS slope, round(any_value(level), 4) AS level, round(avg(CASE WHEN abs(v - level - slope * d) <= {bound} THEN 1.0 ELSE 0.0 END), 4) AS inside FROM r JOIN l{rounds} USING (track) GROUP BY track"


@query("q148_robust_lines", f"WITH {OBS}, o AS (SELECT track, (t - 1704067200) / 86400 AS t, x FROM obs), {_huber(6, 8.0)}")
def q148(spark, d):
    from .operators.regress import robust_lines

    o = observations(spark, d).withColumn("day", (F.col("t") - 1704067200) / DAY)
    return robust_lines(o, ["track"], "day", "x", 8.0).select("track", (r("slope", 5) + 0.0).alias("slope"), r("level").alias("level"), r("inside").alias("inside"))


_TH = f"th * 2 * {math.pi!r} / 180"


@query("q149_line_segments", f"""
WITH RECURSIVE {OBS}, p AS (SELECT DISTINCT CAST(floor(x) AS BIGINT) AS px, y AS py FROM obs), a AS (SELECT unnest(generate_series(0, 89)) AS th), h AS MATERIALIZED (SELECT th, CAST(round_even(round(px * cos({_TH}) + py * sin({_TH}), 6), 0) AS BIGINT) AS rho, count(*) AS n FROM p, a GROUP BY 1, 2),
k AS MATERIALIZED (SELECT * FROM (SELECT h.*, (SELECT max(g.n) FROM h g WHERE abs(g.th - h.th) <= 1 AND abs(g.rho - h.rho) <= 1) AS top FROM h WHERE n > 20) WHERE n = top),
hit AS (SELECT k.th, k.rho, px, py, round(-px * sin(k.th * 2 * {math.pi!r} / 180) + py * cos(k.th * 2 * {math.pi!r} / 180), 6) AS u FROM p JOIN k ON abs(CAST(round_even(round(px * cos(k.th * 2 * {math.pi!r} / 180) + py * sin(k.th * 2 * {math.pi!r} / 180), 6), 0) AS BIGINT) - k.rho) <= 1),
g AS (SELECT *, CASE WHEN u - lag(u) OVER (PARTITION BY th, rho ORDER BY u, px, py) > 3 THEN 1 ELSE 0 END AS new FROM hit), c AS (SELECT *, sum(new) OVER (PARTITION BY th, rho ORDER BY u, px, py ROWS UNBOUNDED PRECEDING) AS run FROM g),
s AS (SELECT th, rho, min(u) AS u0, max(u) AS u1, count(*) AS n FROM c GROUP BY th, rho, run HAVING max(u) - min(u) >= 20),
e AS (SELECT a.th AS th, a.rho AS rho, b.th AS th2, b.rho AS rho2 FROM k a JOIN k b ON abs(a.th - b.th) <= 1 AND abs(a.rho - b.rho) <= 2),
w AS (SELECT th, rho, th AS th2, rho AS rho2 FROM k UNION SELECT w.th, w.rho, e.th2, e.rho2 FROM w JOIN e ON w.th2 = e.th AND w.rho2 = e.rho),
q AS (SELECT th, rho, min(th2 * 1000000 + rho2) AS part FROM w GROUP BY th, rho), b AS (SELECT part, th, rho FROM k JOIN q USING (th, rho) QUALIFY row_number() OVER (PARTITION BY part ORDER BY n DESC, th, rho) = 1),
o AS (SELECT b.th, b.rho, s.u0, s.u1, s.n, s.th AS t, s.rho AS r FROM s JOIN q ON s.th = q.th AND s.rho = q.rho JOIN b ON b.part = q.part), v AS (SELECT *, CASE WHEN u0 > max(u1) OVER (PARTITION BY th, rho ORDER BY u0, u1, t, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM o),
z AS (SELECT *, sum(new) OVER (PARTITION BY th, rho ORDER BY u0, u1, t, r ROWS UNBOUNDED PRECEDING) AS seg FROM v) SELECT CAST(th AS BIGINT) AS th, rho, round(min(u0), 3) AS u0, round(max(u1), 3) AS u1, max(n) AS n FROM z GROUP BY th, rho, seg""")
def q149(spark, d):
    from .operators.segments import segments

    p = held(observations(spark, d).select(F.floor("x").alias("px"), F.col("y").alias("py")).distinct())
    return segments(p, paths.hough(p, 90, 20), 90, 3.0, 20.0).select("th", "rho", r("u0", 3).alias("u0"), r("u1", 3).alias("u1"), "n")


@query("q156_aligned_families", f"""
WITH {OBS}, a AS (SELECT id, CAST(floor(t / 7200) AS BIGINT) AS frame, CAST(y AS DOUBLE) * 1.8 AS rotation, x, CAST(y AS DOUBLE) * 3 AS y, kind = 'view' AS anchored FROM obs),
n AS (SELECT *, CASE WHEN abs((rotation + 90) % 180 - 90) < 15 THEN 0 WHEN abs((rotation + 180) % 180 - 90) < 15 THEN 90 END AS axis FROM a), k AS (SELECT *, (rotation - axis + 90 + 180) % 180 - 90 AS tilt FROM n),
m AS (SELECT frame, axis, count(*) AS c, median(tilt) AS m FROM k WHERE axis IS NOT NULL GROUP BY frame, axis), s AS (SELECT frame, axis, any_value(c) AS c, any_value(m) AS m, median(abs(tilt - m)) AS dev FROM k JOIN m USING (frame, axis) GROUP BY frame, axis),
f AS (SELECT frame, axis FROM s WHERE (c >= 3 AND dev <= 4 AND abs(m) <= 4) OR (c >= 5 AND dev <= 8 AND abs(m) <= 6)),
z AS (SELECT k.*, f.frame IS NOT NULL AND abs(tilt) >= 0.005 AS moved FROM k LEFT JOIN f ON f.frame = k.frame AND f.axis = k.axis)
SELECT id, moved, round(CASE WHEN moved THEN rotation - tilt ELSE rotation END, 4) AS rotation, round(x + CASE WHEN moved AND NOT anchored THEN (cos(radians(-rotation)) - cos(radians(tilt - rotation))) * 3450 ELSE 0 END, 3) AS x, round(y - CASE WHEN moved AND NOT anchored THEN (sin(radians(-rotation)) - sin(radians(tilt - rotation))) * 3450 ELSE 0 END, 3) + 0 AS y FROM z""")
def q156(spark, d):
    o = observations(spark, d)
    a = o.select("id", F.floor(F.col("t") / 7200).alias("frame"), (F.col("y") * 1.8).alias("rotation"), "x", (F.col("y") * 3.0).alias("y"), (F.col("kind") == "view").alias("anchored"))
    f = paths.aligned_families(a, ["frame"], 15.0, (3, 4.0, 4.0), (5, 8.0, 6.0))
    return f.select("id", "moved", r("rotation").alias("rotation"), r("x", 3).alias("x"), (r("y", 3) + 0.0).alias("y"))
