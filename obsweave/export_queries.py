"""Queries on recovery, exchanges, exports and audits, with the DuckDB SQL that gives the same rows."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import events, greedy, joins, motion, ordered, paths
from .queries import DAY, HOLDS, HOUR, OBS, query, r, w
from .sources.tables import holds, observations, table

Q = "WINDOW q AS (PARTITION BY track ORDER BY t, id)"


@query("q125_pinned_contacts", f"""
WITH {OBS}, c AS (SELECT *, lag(t) OVER q AS contact FROM obs {Q}) SELECT track, id, coalesce(kind <> 'signup' AND id % 9 <> 0 AND x >= 30 AND y >= 40 AND abs(t - contact) > 3600 AND abs(t - contact) <= 36000, false) AS pin FROM c""")
def q125(spark, d):
    o = observations(spark, d).withColumn("contact", F.lag("t").over(w()))
    pin = events.pinned(F.col("t"), F.col("contact"), F.col("x") / 40, F.col("y") / 40 * 0.75, F.col("kind") == "signup", F.col("id") % 9 == 0, HOUR, 10 * HOUR)
    return o.select("track", "id", pin.alias("pin"))


@query("q126_exchange_pairs", f"""
WITH {HOLDS}, p AS (SELECT a.ok, a.ln, a.pk, a.price, b.ok AS other_ok, b.ln AS other_ln, row_number() OVER (PARTITION BY a.pk, a.ok, a.ln, a.price ORDER BY abs(b.t - a.t), b.ok, b.ln) AS k, abs(b.t - a.t) AS gap FROM holds a JOIN holds b ON a.pk = b.pk AND (a.duration > 0) = (b.duration > 0) AND abs(b.t - a.t) <= 4320000 AND a.fake AND NOT b.fake)
SELECT ok, ln, pk, round(price, 2) AS price, other_ok, other_ln, round(gap, 1) AS gap FROM p WHERE k = 1""")
def q126(spark, d):
    h = holds(spark, d).withColumn("atoms", F.when(F.col("duration") > 0, 2).otherwise(1)).select("ok", "ln", "pk", "price", "t", "atoms", "fake")
    j = joins.band_join(h.where("fake"), h.where("NOT fake"), ["pk", "atoms"], "t", -50 * DAY, 50 * DAY)
    j = joins.argmin_per(j, ["pk", "ok", "ln", "price"], F.abs(F.col("t_r") - F.col("t")), "ok_r", "ln_r")
    return j.select("ok", "ln", "pk", r("price", 2).alias("price"), F.col("ok_r").alias("other_ok"), F.col("ln_r").alias("other_ln"), r(F.abs(F.col("t_r") - F.col("t")), 1).alias("gap"))


SPANS = """i AS (SELECT *, lag(t) OVER (PARTITION BY track ORDER BY t, id) AS p FROM obs), g AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS k FROM i)"""


@query("q127_approach_recovery", f"""
WITH {OBS}, {SPANS}, m AS (SELECT *, max(t) OVER (PARTITION BY track, k) AS m FROM g), s AS (SELECT track, CAST(k AS BIGINT) AS k, min(t) AS lo, max(t) AS hi, count(*) AS n, regr_slope(y, (t - m) / 3600) AS slope, regr_intercept(y, (t - m) / 3600) AS at_end FROM m GROUP BY track, k HAVING count(*) >= 3),
c AS (SELECT e.track, e.id, s.k, s.n, abs(s.at_end + s.slope * (e.t - s.hi) / 3600 - e.y) AS miss FROM obs e JOIN s ON s.track = e.track AND e.t > s.hi AND e.t - s.hi <= 86400 WHERE e.kind = 'error'),
b AS (SELECT *, row_number() OVER (PARTITION BY track, id ORDER BY round(miss - n * 1.2, 6), k) AS j FROM c WHERE miss <= 60) SELECT track, id, k AS span, round(miss, 4) AS miss FROM b WHERE j = 1""")
def q127(spark, d):
    o = observations(spark, d)
    g = ordered.gap_islands(o, ["track"], "t", 12 * HOUR, "id", "span").withColumn("m", F.max("t").over(Window.partitionBy("track", "span")))
    s = g.groupBy("track", "span").agg(F.max("t").alias("t"), F.count("*").alias("n"), F.expr("regr_slope(y, (t - m) / 3600)").alias("slope"), F.expr("regr_intercept(y, (t - m) / 3600)").alias("at_end")).where("n >= 3")
    j = joins.band_join(o.where("kind = 'error'").select("track", "id", "t", "y"), s, ["track"], "t", -DAY, 0.0).where("t > t_r")
    j = j.withColumn("miss", F.abs(F.col("at_end_r") + F.col("slope_r") * (F.col("t") - F.col("t_r")) / 3600 - F.col("y"))).where("miss <= 60")
    b = joins.argmin_per(j, ["track", "id"], r(F.col("miss") - F.col("n_r") * 1.2, 6), "span_r")
    return b.select("track", "id", F.col("span_r").alias("span"), r("miss").alias("miss"))


@query("q128_clipped_tail", f"""
WITH {OBS}, v AS (SELECT track, id, t, y, (y - lag(y) OVER q) / nullif((t - lag(t) OVER q) / 3600, 0) AS v FROM obs {Q}),
n AS (SELECT *, lead(t) OVER q AS t1, lead(y) OVER q AS y1, median(v) OVER (PARTITION BY track ORDER BY t, id ROWS BETWEEN 2 FOLLOWING AND 6 FOLLOWING) AS rate FROM v {Q})
SELECT track, id, round(CASE WHEN y < 20 AND rate IS NOT NULL THEN y1 + rate * (t - t1) / 3600 ELSE y END, 4)::DOUBLE AS tail FROM n""")
def q128(spark, d):
    n = paths.velocities(observations(spark, d), ["track"], ["t", "id"], "t", "y", 3600.0)
    n = n.withColumn("t1", F.lead("t").over(w())).withColumn("y1", F.lead("y").over(w())).withColumn("rate", F.percentile("v", F.lit(0.5)).over(w().rowsBetween(2, 6)))
    tail = F.when((F.col("y") < 20) & F.col("rate").isNotNull(), F.col("y1") + F.col("rate") * (F.col("t") - F.col("t1")) / 3600).otherwise(F.col("y"))
    return n.select("track", "id", r(tail.cast("double")).alias("tail"))


@query("q129_region_split", f"""
WITH {OBS}, k AS (SELECT *, lag(t) OVER q AS p FROM obs WHERE NOT (y BETWEEN 20 AND 40 AND x BETWEEN 30 AND 60) {Q}),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS part FROM k)
SELECT CAST(track + (part - 1) * 1000000 AS BIGINT) AS track, count(*) AS n, min(id) AS first FROM g GROUP BY g.track, part HAVING count(*) >= 4""")
def q129(spark, d):
    o = observations(spark, d).where(~(F.col("y").between(20, 40) & F.col("x").between(30, 60)))
    g = ordered.gap_islands(o, ["track"], "t", 12 * HOUR, "id", "part")
    return g.groupBy("track", "part").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n >= 4").select((F.col("track") + (F.col("part") - 1) * 1_000_000).alias("track"), "n", "first")


@query("q130_distinct_proposals", f"""
WITH {OBS}, l AS (SELECT track, list({{'x': -x, 'id': id, 'y': y}} ORDER BY -x, id) AS v FROM obs GROUP BY track),
f AS (SELECT track, list_reduce(list_transform(v, lambda e: [e]), lambda acc, e: CASE WHEN len(list_filter(acc, lambda z: abs(z.x - e[1].x) < 5 AND abs(z.y - e[1].y) < 12)) > 0 THEN acc ELSE list_concat(acc, e) END) AS k FROM l)
SELECT track, u.id AS id, -u.x AS x, u.y AS y FROM (SELECT track, unnest(k) AS u FROM f)""")
def q130(spark, d):
    o = observations(spark, d).withColumn("x", -F.col("x"))
    near = lambda q, e: (F.abs(q["x"] - e["x"]) < 5) & (F.abs(q["y"] - e["y"]) < 12)
    return greedy.suppress(o, "track", ["x", "id"], ["y"], near).select("track", "id", (-F.col("x")).alias("x"), "y")


@query("q131_repairs_appended", f"""
WITH {OBS}, g AS (SELECT track, t, id, lead(t) OVER q AS n FROM obs {Q}) SELECT track, round(t, 3) AS t, 'measured' AS origin FROM obs UNION ALL SELECT track, round(t + (n - t) / 2, 3), 'inferred' FROM g WHERE n - t > 172800""")
def q131(spark, d):
    o = observations(spark, d)
    g = o.withColumn("n", F.lead("t").over(w())).where("n - t > 172800")
    return o.select("track", r("t", 3).alias("t"), F.lit("measured").alias("origin")).union(g.select("track", r(F.col("t") + (F.col("n") - F.col("t")) / 2, 3), F.lit("inferred")))


@query("q132_count_at_time", f"""
WITH {OBS}, a AS (SELECT track, t FROM obs WHERE kind IN ('click', 'purchase')), p AS (SELECT track, id, t FROM obs WHERE kind = 'view') SELECT p.track, p.id, count(a.t) AS combo FROM p LEFT JOIN a ON a.track = p.track AND a.t <= p.t + 3600 GROUP BY p.track, p.id""")
def q132(spark, d):
    o = observations(spark, d)
    return paths.counts_until(o.where("kind IN ('click', 'purchase')").select("track", "t"), o.where("kind = 'view'").select("track", "id", (F.col("t") + HOUR).alias("t")), "track", "t").select("track", "id", "combo")


@query("q133_plateau_grid", f"""
WITH {OBS}, l AS (SELECT *, lag(kind) OVER q AS p FROM obs {Q}), g AS (SELECT *, sum(CASE WHEN kind IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS k FROM l),
s AS (SELECT track, CAST(k AS BIGINT) AS run, min(t) AS lo, max(t) AS hi FROM g GROUP BY track, k HAVING max(t) - min(t) > 43200), n AS (SELECT track, run, lo, unnest(generate_series(0, CAST(floor((hi - lo) / 21600) AS BIGINT))) AS step FROM s)
SELECT track, run, CAST(step AS BIGINT) AS step, round(lo + step * 21600, 3) AS t FROM n""")
def q133(spark, d):
    g = ordered.value_islands(observations(spark, d), ["track"], ["t", "id"], "kind", "run")
    s = g.groupBy("track", "run").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("hi - lo > 43200")
    n = s.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("hi") - F.col("lo")) / 21600))))
    return n.select("track", "run", "step", r(F.col("lo") + F.col("step") * 21600, 3).alias("t"))


@query("q134_rendered_swap", f"""
WITH {OBS}, e AS (SELECT a.track, a.id, b.id AS alt, abs(a.x - a.y) AS now, abs(b.x - b.y) AS score FROM obs a JOIN obs b ON a.track = b.track AND b.kind = 'error' AND abs(b.t - a.t) <= 21600 WHERE a.kind = 'view'),
k AS (SELECT *, row_number() OVER (PARTITION BY track, id ORDER BY score, alt) AS k FROM e) SELECT track, id, alt, round(score, 4) AS score FROM k WHERE k = 1 AND score <= 15 AND now - score >= 8 AND score <= now / 2""")
def q134(spark, d):
    o = observations(spark, d).withColumn("score", F.abs(F.col("x") - F.col("y"))).select("track", "id", "t", "kind", "score")
    j = motion.attach(o.where("kind = 'view'"), o.where("kind = 'error'"), ["track"], "t", -6 * HOUR, 6 * HOUR, F.lit(True), F.col("score_r"), "id_r")
    return j.where("score_r <= 15 AND score - score_r >= 8 AND score_r <= score / 2").select("track", "id", F.col("id_r").alias("alt"), r("score_r").alias("score"))


@query("q135_chart_script", f"""
WITH {OBS}, c AS (SELECT track, t, id, 'note(' || id || ',' || kind || ',' || CAST(CAST(floor(t) AS BIGINT) AS VARCHAR) || ',' || y || ')' AS line FROM obs) SELECT track, count(*) AS notes, sha256(string_agg(line, chr(10) ORDER BY t, id)) AS script, CAST(sum(length(line) + 1) AS BIGINT) AS size, sum(length(line) + 1) <= 1500000 AS fits FROM c GROUP BY track""")
def q135(spark, d):
    c = observations(spark, d).select("track", "t", "id", F.concat(F.lit("note("), F.col("id").cast("string"), F.lit(","), "kind", F.lit(","), F.floor("t").cast("string"), F.lit(","), F.col("y").cast("string"), F.lit(")")).alias("line"))
    g = paths.script(c, ["track"], ["t", "id"], "line")
    return g.select("track", "notes", F.sha2("script", 256).alias("script"), "size", (F.col("size") <= 1_500_000).alias("fits"))


@query("q136_bundle_equality", f"""
WITH {OBS}, a AS (SELECT track, count(*) AS n, sum(y) AS s FROM obs GROUP BY track), b AS (SELECT track, count(*) AS n, sum(y) AS s FROM obs WHERE id % 1000 <> 7 GROUP BY track) SELECT count(*) AS tracks, count(*) FILTER (a.n = b.n AND a.s = b.s) AS equal, CAST(sum(a.n) - sum(b.n) AS BIGINT) AS lost FROM a LEFT JOIN b USING (track)""")
def q136(spark, d):
    o = observations(spark, d)
    report = lambda x: x.groupBy("track").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    b = report(o.where("id % 1000 <> 7")).select("track", F.col("n").alias("m"), F.col("s").alias("u"))
    return report(o).join(b, "track", "left").agg(F.count("*").alias("tracks"), F.count_if((F.col("n") == F.col("m")) & (F.col("s") == F.col("u"))).alias("equal"), (F.sum("n") - F.sum("m")).alias("lost"))


@query("q137_json_round_trip", """
SELECT event_id, CAST(json_extract_string(to_json({'k': CAST(json_extract_string(props, '$.k') AS INTEGER), 'v': event_type}), '$.k') AS INTEGER) AS k, json_extract_string(to_json({'k': 1, 'v': event_type}), '$.v') AS v, regexp_matches(CAST(props AS VARCHAR), '^\\{.*\\}$') AS object FROM events""")
def q137(spark, d):
    e = table(spark, d, "events")
    text = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("event_type").alias("v")))
    back = F.from_json(text, "k int, v string")
    return e.select("event_id", back["k"].alias("k"), back["v"].alias("v"), F.col("props").rlike(r"^\{.*\}$").alias("object"))


@query("q138_best_first", f"""
WITH {OBS}, s AS (SELECT id, round(x + 0.5 * y, 4) AS score FROM obs) SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS place FROM s""")
def q138(spark, d):
    s = observations(spark, d).select("id", r(F.col("x") + 0.5 * F.col("y")).alias("score")).withColumn("down", -F.col("score"))
    return paths.numbered(s, ["down", "id"]).select("id", "score", "place")


@query("q139_greedy_lines", f"""
WITH {OBS}, o AS (SELECT a.track, a.id, z.id AS line, round(abs(a.x - z.x) + 3 * abs(a.y - z.y), 6) AS cost FROM obs a JOIN obs z ON a.track = z.track AND z.kind = 'purchase' AND a.t - z.t BETWEEN 0 AND 86400 WHERE a.kind = 'view' AND abs(a.y - z.y) < 25 AND abs(a.x - z.x) < 22),
l AS (SELECT track, list([{{'id': id, 'line': line}}] ORDER BY id, cost, line) AS offers FROM o GROUP BY track)
SELECT track, e.id AS id, e.line AS line FROM (SELECT track, unnest(list_reduce(offers, lambda a, c: CASE WHEN len(list_filter(a, lambda z: z.id = c[1].id OR z.line = c[1].line)) = 0 THEN list_concat(a, c) ELSE a END)) AS e FROM l)""")
def q139(spark, d):
    from .operators.budgets import budgeted

    o = observations(spark, d).select("track", "id", "t", "x", "y", "kind")
    a, z = o.where("kind = 'view'"), o.where("kind = 'purchase'")
    dx, dy = F.abs(F.col("x") - F.col("x_r")), F.abs(F.col("y") - F.col("y_r"))
    near = joins.band_join(a, z, ["track"], "t", -DAY, 0.0).where((dy < 25) & (dx < 22))
    offers = near.select("track", "id", F.col("id_r").alias("line"), r(dx + 3 * dy, 6).alias("cost"), F.col("id").cast("double").alias("own"), F.lit(0.0).alias("place"))
    one = offers.select("track", "id").distinct().withColumn("budget", F.lit(1).cast("long"))
    # detections in order, each with the cheapest line that is free; none suppresses another but by its line
    return budgeted(offers, one, "track", "id", "line", ["cost"], "own", ["place"], 0.25, 0.25).select("track", "id", "line")


@query("q140_editor_window", f"""
WITH {OBS}, m AS (SELECT min(t) + 864000 AS now FROM obs), k AS (SELECT id, round(t, 3) AS t, kind, row_number() OVER (ORDER BY t, id) AS k FROM obs, m WHERE abs(t - now) <= 43200) SELECT id, t, kind FROM k WHERE k <= 300""")
def q140(spark, d):
    o = observations(spark, d)
    now = o.agg((F.min("t") + 10 * DAY).alias("now"))  # one row
    near = o.join(F.broadcast(now), F.abs(F.col("t") - F.col("now")) <= 12 * HOUR)
    return near.orderBy("t", "id").limit(300).select("id", r("t", 3).alias("t"), "kind")


@query("q141_nearest_event", f"""
WITH {OBS}, c AS (SELECT a.track, a.id, b.id AS near, 35 * abs(b.t - a.t) / 86400 + abs(b.x - a.x) AS cost FROM obs a JOIN obs b ON a.track = b.track AND b.kind = 'purchase' WHERE a.kind = 'error'),
k AS (SELECT *, row_number() OVER (PARTITION BY track, id ORDER BY round(cost, 9), near) AS k FROM c) SELECT track, id, near, round(cost, 4) AS cost FROM k WHERE k = 1""")
def q141(spark, d):
    o = observations(spark, d).select("track", "id", "t", "x", "kind")
    j = joins.nearest(o.where("kind = 'error'").drop("kind"), o.where("kind = 'purchase'").drop("kind"), ["track"], "t", "x", 35 / DAY, DAY)
    return j.select("track", "id", F.col("id_r").alias("near"), r("cost").alias("cost"))


@query("q142_seeded_random", """
WITH s AS (SELECT event_id, CAST(event_id + 1 AS BIGINT) AS a FROM events), b AS (SELECT event_id, xor(a, (a << 13) & 4294967295) AS a FROM s), c AS (SELECT event_id, xor(a, a >> 17) AS a FROM b), e AS (SELECT event_id, xor(a, (a << 5) & 4294967295) AS a FROM c)
SELECT event_id, a AS state, round(a / 4294967296, 9) AS draw FROM e""")
def q142(spark, d):
    from .functions.scalar import xorshift32

    e = table(spark, d, "events").select("event_id", xorshift32(F.col("event_id") + 1).alias("state"))
    return e.select("event_id", "state", r(F.col("state") / 4294967296, 9).alias("draw"))


@query("q145_phase_rows", f"""
WITH {OBS}, clean AS (SELECT * FROM obs WHERE kind <> 'error' AND x >= 5), step AS (SELECT track, t - lag(t) OVER (PARTITION BY track ORDER BY t, id) AS gap FROM clean), slow AS (SELECT track FROM step GROUP BY track HAVING max(gap) > 86400)
SELECT 'read' AS phase, count(*) AS rows, round(sum(x), 2) AS total FROM obs UNION ALL SELECT 'clean', count(*), round(sum(x), 2) FROM clean UNION ALL SELECT 'tracks', count(*), NULL FROM slow""")
def q145(spark, d):
    from .plans.progress import Phases, by_phase
    from .sources.shared import shared_folder

    run = Phases(spark, "audit")
    o = run.counted(observations(spark, d), "read", total=F.sum("x"))
    clean = run.counted(o.where("kind <> 'error' AND x >= 5"), "clean", total=F.sum("x"))
    gaps = clean.withColumn("gap", F.col("t") - F.lag("t").over(w())).groupBy("track").agg(F.max("gap").alias("gap"))
    root = shared_folder(spark, "audit")
    run.counted(gaps.where(F.col("gap") > DAY), "tracks").write.parquet(f"{root}/tracks")  # one pass counts all three
    run.settle()
    run.save(f"{root}/progress")
    table_ = spark.read.parquet(f"{root}/progress")
    totals = table_.select("phase", r(F.try_element_at("metrics", F.lit("total")), 2).alias("total"))
    return by_phase(table_).join(totals, "phase").select("phase", "rows", "total")


@query("q150_rotation_repair", f"""
WITH {OBS}, c AS (SELECT track AS hold, (t - 1704067200) / 86400 AS t, degrees(atan2(150, x - 40)) AS deg FROM obs WHERE y * 9 - 150 BETWEEN -720 * 0.22 AND 720 + 720 * 0.22 AND y * 9 BETWEEN -720 * 0.22 AND 720 + 720 * 0.22 AND sqrt((x - 40) * (x - 40) + 22500) BETWEEN 80 AND 800),
g AS (SELECT track AS hold, min((t - 1704067200) / 86400) AS t0, max((t - 1704067200) / 86400) AS t1 FROM obs GROUP BY track),
m AS (SELECT hold, t, list_sort([coalesce(lag(deg) OVER o, deg), deg, coalesce(lead(deg) OVER o, deg)])[2] AS a FROM c WINDOW o AS (PARTITION BY hold ORDER BY t)),
a AS (SELECT hold, t, CASE WHEN abs(a - 90) < 0.4 THEN 90 ELSE a END AS angle, CASE WHEN t1 > t0 THEN 96 - 20 * (t - t0) / (t1 - t0) ELSE 96 END AS told FROM m JOIN g USING (hold)),
b AS (SELECT *, abs((angle - told + 270) % 180 - 90) > 8 AS bad FROM a), n AS (SELECT *, CASE WHEN bad IS DISTINCT FROM lag(bad) OVER o OR t - lag(t) OVER o > 2 THEN 1 ELSE 0 END AS new FROM b WINDOW o AS (PARTITION BY hold ORDER BY t)), r AS (SELECT *, sum(new) OVER (PARTITION BY hold ORDER BY t) AS run FROM n),
w AS (SELECT DISTINCT hold FROM (SELECT hold, count(*) AS k FROM r WHERE bad GROUP BY hold, run HAVING count(*) >= 3) WHERE hold IN (SELECT hold FROM a GROUP BY hold HAVING count(*) >= 4)),
e AS (SELECT hold, t0 AS t, 96.0 AS degrees FROM g UNION ALL SELECT hold, t1, 76.0 FROM g WHERE t1 > t0)
SELECT hold, round(t, 6) AS t, round(degrees, 4) AS degrees, hold IN (SELECT hold FROM w) AS repaired FROM e WHERE NOT (hold IN (SELECT hold FROM w) AND EXISTS (SELECT 1 FROM a WHERE a.hold = e.hold AND a.t = e.t)) UNION ALL SELECT hold, round(t, 6), round(angle, 4), true FROM a WHERE hold IN (SELECT hold FROM w)""")
def q150(spark, d):
    from .operators.holds import repaired_rotations

    o = observations(spark, d).select(F.col("track").alias("hold"), ((F.col("t") - 1704067200) / DAY).alias("t"), F.col("x"), (F.col("y") * 9.0).alias("hy"))
    caps = o.select("hold", "t", F.lit(0.0).alias("hx"), "hy", (F.col("x") - 40).alias("tx"), (F.col("hy") - 150).alias("ty"))
    span = o.groupBy("hold").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    given = span.select("hold", F.explode(F.array_distinct(F.array(F.struct(F.col("t0").alias("t"), F.lit(96.0).alias("degrees")), F.struct(F.col("t1").alias("t"), F.when(F.col("t1") > F.col("t0"), 76.0).otherwise(96.0).alias("degrees"))))).alias("p")).select("hold", "p.*")
    return repaired_rotations(caps, given, gap=2.0).select("hold", r("t", 6).alias("t"), r("degrees", 4).alias("degrees"), "repaired")


@query("q151_doubled_sprites", f"""
WITH {OBS}, p AS (SELECT track AS video, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], kind) AS BIGINT) AS event, (t - 1704067200) / 86400 AS t, min(x) AS x, CAST(min(y) AS DOUBLE) AS y FROM obs GROUP BY 1, 2, 3),
s AS (SELECT video, event, count(*) AS n, min(t) AS t0, max(t) AS t1 FROM p GROUP BY 1, 2 HAVING count(*) >= 4),
k AS (SELECT a.video, a.event AS a, b.event AS b, greatest(a.t0, b.t0) AS lo, least(a.t1, b.t1) AS hi, a.n AS na, b.n AS nb FROM s a JOIN s b ON a.video = b.video AND a.event < b.event WHERE (a.event <> 3 OR b.event <> 3) AND least(a.t1, b.t1) - greatest(a.t0, b.t0) >= 2),
q AS (SELECT video, a, b, CASE WHEN i = greatest(5, CAST(floor(hi - lo) AS INTEGER) + 1) - 1 THEN hi ELSE lo + i * (hi - lo) / (greatest(5, CAST(floor(hi - lo) AS INTEGER) + 1) - 1) END AS t FROM k, LATERAL (SELECT unnest(range(greatest(5, CAST(floor(hi - lo) AS INTEGER) + 1))) AS i)
      UNION SELECT k.video, a, b, p.t FROM k JOIN p ON p.video = k.video AND (p.event = k.a OR p.event = k.b) AND p.t BETWEEN lo AND hi),
u AS (SELECT q.*, al.t AS alt, al.x AS alx, al.y AS aly, ar.t AS art, ar.x AS arx, ar.y AS ary FROM q ASOF JOIN p al ON al.video = q.video AND al.event = q.a AND q.t >= al.t ASOF JOIN p ar ON ar.video = q.video AND ar.event = q.a AND q.t <= ar.t),
v AS (SELECT u.*, bl.t AS blt, bl.x AS blx, bl.y AS bly, br.t AS brt, br.x AS brx, br.y AS bry FROM u ASOF JOIN p bl ON bl.video = u.video AND bl.event = u.b AND u.t >= bl.t ASOF JOIN p br ON br.video = u.video AND br.event = u.b AND u.t <= br.t),
f AS (SELECT video, a, b, CASE WHEN alt = art THEN alx ELSE alx + (arx - alx) * (t - alt) / (art - alt) END - CASE WHEN blt = brt THEN blx ELSE blx + (brx - blx) * (t - blt) / (brt - blt) END AS dx, CASE WHEN alt = art THEN aly ELSE aly + (ary - aly) * (t - alt) / (art - alt) END - CASE WHEN blt = brt THEN bly ELSE bly + (bry - bly) * (t - blt) / (brt - blt) END AS dy FROM v),
z AS (SELECT f.video, f.a, f.b FROM f GROUP BY 1, 2, 3 HAVING count(*) >= 4 AND median(sqrt(dx * dx + dy * dy)) <= 40 AND avg(CASE WHEN sqrt(dx * dx + dy * dy) < 60 THEN 1.0 ELSE 0.0 END) >= 0.75),
o AS (SELECT z.*, CASE WHEN a = 3 THEN b WHEN b = 3 THEN a WHEN na >= nb THEN b ELSE a END AS goes FROM z JOIN k USING (video, a, b)),
l AS (SELECT video, list_reduce(list_prepend({{'gone': CAST([] AS BIGINT[]), 'a': CAST(NULL AS BIGINT), 'b': CAST(NULL AS BIGINT), 'goes': CAST(NULL AS BIGINT), 'there': true}}, list({{'gone': CAST([] AS BIGINT[]), 'a': a, 'b': b, 'goes': goes, 'there': true}} ORDER BY a, b)), lambda s, p: {{'gone': CASE WHEN (CASE WHEN s.a IS NOT DISTINCT FROM p.a THEN s.there ELSE NOT list_contains(s.gone, p.a) END) AND NOT list_contains(s.gone, p.b) THEN list_append(s.gone, p.goes) ELSE s.gone END, 'a': p.a, 'b': p.b, 'goes': p.goes, 'there': CASE WHEN s.a IS NOT DISTINCT FROM p.a THEN s.there ELSE NOT list_contains(s.gone, p.a) END}}) AS r FROM o GROUP BY video)
SELECT DISTINCT video, unnest(r.gone) AS event FROM l""")
def q151(spark, d):
    from .operators.holds import sprite_duplicates

    event = F.array_position(F.array(*(F.lit(k) for k in ("click", "error", "purchase", "signup", "view"))), F.col("kind"))
    p = observations(spark, d).select(F.col("track").alias("video"), event.alias("event"), ((F.col("t") - 1704067200) / DAY).alias("t"), "x", F.col("y").cast("double").alias("y"))
    e = p.select("video", "event").distinct().select("video", "event", (F.col("event") != 3).alias("fake"), F.lit(None).cast("int").alias("type"), F.lit(0).alias("frames"), F.lit("high").alias("confidence"))
    return sprite_duplicates(e, p, overlap=2.0, median=40.0, close=60.0, cell=40.0, fps=1.0).select("video", "event")


_AT = "CASE WHEN {s}lt = {s}rt THEN {s}l{c} ELSE {s}l{c} + ({s}r{c} - {s}l{c}) * (t - {s}lt) / ({s}rt - {s}lt) END"


@query("q152_hollow_duplicates", f"""
WITH {OBS}, p AS (SELECT track AS video, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], kind) AS BIGINT) AS event, (t - 1704067200) / 86400 AS t, min(x) AS x, CAST(min(y) AS DOUBLE) AS y FROM obs GROUP BY 1, 2, 3),
s AS (SELECT video, event, count(*) AS n, min(t) AS t0, max(t) AS t1, arg_max(x, t) AS zx, arg_max(y, t) AS zy, CASE WHEN event <= 2 THEN 1 END AS target, round(min(x) / 100, 6) AS ring FROM p GROUP BY 1, 2),
k AS (SELECT a.video, a.event AS a, b.event AS b, greatest(a.t0, b.t0) AS lo, least(a.t1, b.t1) AS hi, coalesce(a.target = b.target AND abs(a.t1 - b.t1) < 1.5 AND sqrt((a.zx - b.zx) ** 2 + (a.zy - b.zy) ** 2) < 60, false) OR (abs(a.t1 - b.t1) < 1 AND sqrt((a.zx - b.zx) ** 2 + (a.zy - b.zy) ** 2) < 30) AS near,
      round(CASE WHEN a.target IS NULL THEN 0 ELSE 8 END + 2 * a.ring + least(3, 0.12 * a.n), 9) AS ra, round(CASE WHEN b.target IS NULL THEN 0 ELSE 8 END + 2 * b.ring + least(3, 0.12 * b.n), 9) AS rb FROM s a JOIN s b ON a.video = b.video AND a.event < b.event WHERE a.n >= 2 AND b.n >= 2),
q AS (SELECT video, a, b, CASE WHEN i = 8 THEN hi ELSE lo + i * (hi - lo) / 8 END AS t FROM k, range(9) AS g(i) WHERE NOT near AND hi - lo >= 3),
u AS (SELECT q.*, al.t AS alt, al.x AS alx, al.y AS aly, ar.t AS art, ar.x AS arx, ar.y AS ary FROM q ASOF JOIN p al ON al.video = q.video AND al.event = q.a AND q.t >= al.t ASOF JOIN p ar ON ar.video = q.video AND ar.event = q.a AND q.t <= ar.t),
v AS (SELECT u.*, bl.t AS blt, bl.x AS blx, bl.y AS bly, br.t AS brt, br.x AS brx, br.y AS bry FROM u ASOF JOIN p bl ON bl.video = u.video AND bl.event = u.b AND u.t >= bl.t ASOF JOIN p br ON br.video = u.video AND br.event = u.b AND u.t <= br.t),
f AS (SELECT video, a, b, {_AT.format(s="a", c="x")} - {_AT.format(s="b", c="x")} AS dx, {_AT.format(s="a", c="y")} - {_AT.format(s="b", c="y")} AS dy FROM v),
z AS (SELECT video, a, b FROM k WHERE near UNION ALL SELECT video, a, b FROM f GROUP BY 1, 2, 3 HAVING median(sqrt(dx * dx + dy * dy)) < 35),
l AS (SELECT video, list_reduce(list_prepend({{'gone': CAST([] AS BIGINT[]), 'a': CAST(NULL AS BIGINT), 'b': CAST(NULL AS BIGINT), 'goes': CAST(NULL AS BIGINT)}}, list({{'gone': CAST([] AS BIGINT[]), 'a': a, 'b': b, 'goes': CASE WHEN ra >= rb THEN b ELSE a END}} ORDER BY a, b)), lambda s, p: {{'gone': CASE WHEN list_contains(s.gone, p.a) OR list_contains(s.gone, p.b) THEN s.gone ELSE list_append(s.gone, p.goes) END, 'a': p.a, 'b': p.b, 'goes': p.goes}}) AS r FROM z JOIN k USING (video, a, b) GROUP BY video)
SELECT video, unnest(r.gone) AS event FROM l""")
def q152(spark, d):
    from .operators.holds import hollow_duplicates

    event = F.array_position(F.array(*(F.lit(k) for k in ("click", "error", "purchase", "signup", "view"))), F.col("kind"))
    p = observations(spark, d).select(F.col("track").alias("video"), event.alias("event"), ((F.col("t") - 1704067200) / DAY).alias("t"), "x", F.col("y").cast("double").alias("y"))
    e = p.groupBy("video", "event").agg(F.max("t").alias("time"), r(F.min("x") / 100, 6).alias("ring")).select("video", "event", "time", F.when(F.col("event") <= 2, F.lit(1)).cast("long").alias("target"), "ring", F.lit(0.0).alias("head"))
    return hollow_duplicates(e, p, same=(1.5, 60.0), along=(3.0, 35.0), touch=(1.0, 30.0), cell=40.0).select("video", "event")


def _sprites(spark, d):
    """video, event, t, x, y: a user's events of one kind as a path, t in days."""
    event = F.array_position(F.array(*(F.lit(k) for k in ("click", "error", "purchase", "signup", "view"))), F.col("kind"))
    return observations(spark, d).select(F.col("track").alias("video"), event.alias("event"), ((F.col("t") - 1704067200) / DAY).alias("t"), "x", F.col("y").cast("double").alias("y"))


SPRITES = f"""{OBS}, p AS (SELECT track AS video, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], kind) AS BIGINT) AS event, (t - 1704067200) / 86400 AS t, x, CAST(y AS DOUBLE) AS y FROM obs),
g AS (SELECT video, event AS b, t AS t0, x AS x0, y AS y0, lead(t) OVER o AS t1, lead(x) OVER o AS x1, lead(y) OVER o AS y1 FROM p WINDOW o AS (PARTITION BY video, event ORDER BY t)),
m AS (SELECT p.video, p.event AS a, g.b, count(*) AS n FROM p JOIN g ON p.video = g.video AND p.event <> g.b AND p.t >= g.t0 AND (p.t < g.t1 OR (g.t1 IS NULL AND p.t = g.t0))
      WHERE CASE WHEN t1 IS NULL THEN sqrt((x - x0) ** 2 + (y - y0) ** 2) ELSE sqrt((x - x0 - (t - t0) / (t1 - t0) * (x1 - x0)) ** 2 + (y - y0 - (t - t0) / (t1 - t0) * (y1 - y0)) ** 2) END < 25 GROUP BY 1, 2, 3)"""


@query("q153_path_matches", f"WITH {SPRITES} SELECT video, a, b, n FROM m WHERE n >= 2")
def q153(spark, d):
    from .operators.holds import path_matches

    p = _sprites(spark, d)
    return path_matches(p, p, 25.0, 2, 2.0)


@query("q154_supported_twins", f"""
WITH {SPRITES}, e AS (SELECT video, event, max(t) AS t, max(x) >= 60 AS strong FROM p GROUP BY 1, 2) SELECT video, event FROM e WHERE NOT strong AND EXISTS (SELECT 1 FROM m JOIN e z ON z.video = m.video AND z.event = m.b WHERE m.video = e.video AND m.a = e.event AND m.n >= 3 AND z.strong AND abs(z.t - e.t) <= 5)""")
def q154(spark, d):
    from .operators.holds import path_matches
    from .sources.shared import apart

    p = _sprites(spark, d)
    e = p.groupBy("video", "event").agg(F.max("t").alias("at"), (F.max("x") >= 60).alias("strong"))
    weak, strong = e.where("NOT strong"), e.where("strong")
    # weak approaches with a well supported twin on the same path
    twins = path_matches(p.join(apart(weak), ["video", "event"], "left_semi"), p.join(apart(strong), ["video", "event"], "left_semi"), 25.0, 3, 2.0)
    near = twins.join(apart(strong.select("video", F.col("event").alias("b"), F.col("at").alias("there"))), ["video", "b"])
    return weak.join(apart(near.select("video", F.col("a").alias("event"), "there")), ["video", "event"]).where(F.abs(F.col("at") - F.col("there")) <= 5).select("video", "event").distinct()


@query("q155_anchors_of_a_track", f"""
WITH {OBS}, g AS (SELECT track, unnest(generate_series(CAST(ceil(min(t) / 86400) AS BIGINT), CAST(floor(max(t) / 86400) AS BIGINT))) AS day FROM obs GROUP BY track),
c AS (SELECT g.track, o.id, o.t, o.y, row_number() OVER (PARTITION BY g.track, g.day ORDER BY abs(o.t - g.day * 86400), o.id) AS k FROM g JOIN obs o ON o.track = g.track AND abs(o.t - g.day * 86400) <= 15552),
a AS (SELECT track, id, t, y FROM c WHERE k = 1 UNION SELECT track, id, t, y FROM obs WHERE kind = 'purchase'), l AS (SELECT track, list({{'t': t, 'id': id, 'y': y}} ORDER BY t, id) AS v FROM a GROUP BY track),
f AS (SELECT track, list_reduce(list_transform(v, lambda e: [e]), lambda acc, e: CASE WHEN e[1].y >= acc[-1].y THEN list_concat(acc, e) ELSE acc END) AS k FROM l),
h AS (SELECT track, list_reduce(list_transform(k, lambda e: [e]), lambda acc, e: CASE WHEN e[1].t - acc[-1].t >= 43200 THEN list_concat(acc, e) ELSE acc END) AS k FROM f) SELECT track, u.id AS id, u.y AS y FROM (SELECT track, unnest(k) AS u FROM h)""")
def q155(spark, d):
    o = observations(spark, d)
    g = o.groupBy("track").agg(F.explode(F.sequence(F.ceil(F.min("t") / DAY), F.floor(F.max("t") / DAY))).alias("day")).withColumn("t", F.col("day") * DAY)
    dense = joins.argmin_per(joins.band_join(g, o.select("track", "id", "t", "y"), ["track"], "t", -0.18 * DAY, 0.18 * DAY), ["track", "day"], F.abs(F.col("t_r") - F.col("t")), "id_r")
    both = dense.select("track", F.col("id_r").alias("id"), F.col("t_r").alias("t"), F.col("y_r").alias("y")).union(o.where("kind = 'purchase'").select("track", "id", "t", "y")).distinct()
    rising = greedy.monotone(both, ["track"], ["t", "id"], ["y"], lambda q, e: e["y"] >= q["y"])
    return greedy.monotone(rising, ["track"], ["t", "id"], ["y"], lambda q, e: e["t"] - q["t"] >= 12 * HOUR).select("track", "id", "y")


@query("q157_extended_events", f"""
WITH {SPRITES}, o AS (SELECT video, a, min(b) AS event FROM m WHERE n >= 2 AND a <= 3 AND b > 3 GROUP BY video, a), s AS (SELECT video, event, min(t) AS t0, max(t) AS t1 FROM p GROUP BY video, event),
k AS (SELECT p.video, o.event, p.t, p.x, p.y, o.a AS track, row_number() OVER (PARTITION BY p.video, o.event, p.t ORDER BY o.a, p.x, p.y) AS k FROM p JOIN o ON p.video = o.video AND p.event = o.a JOIN s ON s.video = o.video AND s.event = o.event WHERE p.t < t0 OR p.t > t1)
SELECT video, event, round(t, 6) AS t, x, y, track FROM k WHERE k = 1""")
def q157(spark, d):
    from .operators.holds import extended_by

    p = _sprites(spark, d)
    return extended_by(p.where("event > 3"), p.where("event <= 3"), 25.0, 2, 2.0).select("video", "event", r("t", 6).alias("t"), "x", "y", "track")


@query("q158_script_commands", f"""
WITH {OBS}, n AS (SELECT track AS video, id, round((t - 1704067200) / 14400, 3) AS hit, CASE WHEN y % 4 = 0 THEN 0.75 ELSE 0.0 END AS duration, kind, kind = 'error' AS fake FROM obs WHERE kind IN ('view', 'click', 'error')),
s AS (SELECT *, greatest(0.0, hit - 0.6) AS start, hit + duration AS "end" FROM n),
l AS (SELECT video, fake, list({{'ends': ["end" + 0.55], 'out': [{{'id': id, 'slot': 0}}], 's': start, 'e': "end" + 0.55, 'i': id}} ORDER BY start, id) AS v FROM s GROUP BY video, fake),
f AS (SELECT video, fake, list_reduce(v, lambda a, z: {{'ends': CASE WHEN coalesce(list_position(list_transform(a.ends, lambda q: q + 0.001 < z.s), true), 0) > 0 THEN list_concat(list_concat(a.ends[1:list_position(list_transform(a.ends, lambda q: q + 0.001 < z.s), true) - 1], [z.e]), a.ends[list_position(list_transform(a.ends, lambda q: q + 0.001 < z.s), true) + 1:]) ELSE list_append(a.ends, z.e) END,
'out': list_append(a.out, {{'id': z.i, 'slot': CAST(CASE WHEN coalesce(list_position(list_transform(a.ends, lambda q: q + 0.001 < z.s), true), 0) > 0 THEN list_position(list_transform(a.ends, lambda q: q + 0.001 < z.s), true) - 1 ELSE len(a.ends) END AS INTEGER)}}), 's': z.s, 'e': z.e, 'i': z.i}}) AS r FROM l),
c AS (SELECT f.video, f.fake, u.id, u.slot FROM (SELECT video, fake, unnest(r.out) AS u FROM f) f), k AS (SELECT s.*, slot, row_number() OVER (PARTITION BY s.video, s.fake, slot ORDER BY start, s.id) AS j FROM s JOIN c ON c.video = s.video AND c.fake = s.fake AND c.id = s.id),
o AS (SELECT video, fake, slot, row_number() OVER (PARTITION BY video ORDER BY start, id) - 1 AS carrier FROM k WHERE j = 1), z AS (SELECT k.*, carrier FROM k JOIN o USING (video, fake, slot))
SELECT video, id, 0 AS seq, 'line ' || carrier AS line FROM z WHERE j = 1 UNION ALL SELECT video, id, 1, 'note ' || carrier || ' ' || id || ' ' || printf('%.5f', hit) || ' ' || printf('%.5f', "end") || ' ' || kind || CASE WHEN fake THEN ' fake' ELSE ' real' END FROM z
UNION ALL SELECT video, id, 3, 'show ' || printf('%.5f', greatest(0.0, start - 2e-5)) || ':0 ' || printf('%.5f', greatest(0.0, start - 2e-5) + 1e-5) || ':1 ' || printf('%.5f', "end") || ':1 ' || printf('%.5f', "end" + 1e-5) || ':0' FROM z
UNION ALL SELECT track, id, 0, 'effect purchase ' || id || ' ' || printf('%.5f', round((t - 1704067200) / 14400, 3)) || ' ' || printf('%.5f', round((t - 1704067200) / 14400, 3) + 1) || ' ' || printf('%.3f', y / 200.0) FROM obs WHERE kind = 'purchase'""")
def q158(spark, d):
    from .sources.script import chart_lines

    o = observations(spark, d).withColumn("at", F.round((F.col("t") - 1704067200) / 14400, 3)).withColumnRenamed("track", "video")
    notes = o.where("kind IN ('view', 'click', 'error')").select("video", "id", F.col("at").alias("time"), F.when(F.col("y") % 4 == 0, 0.75).otherwise(0.0).alias("duration"), "kind", (F.col("kind") == "error").alias("fake"))
    effects = o.where("kind = 'purchase'").select("video", "id", "kind", F.col("at").alias("start"), (F.col("at") + 1).alias("end"), (F.col("y") / 200.0).alias("alpha"))
    points = o.limit(0).select("video", "id", F.col("at").alias("t"), F.col("x"), F.col("y").cast("double").alias("y"))
    return chart_lines(notes, points, effects).select("video", "id", "seq", "line")
