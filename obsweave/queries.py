"""Queries over the driver's tables, one for each operator family, with the DuckDB SQL that gives the same rows."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.scalar import clip, evidence_score, reliable, slug, wrap, zigzag
from .operators import greedy, joins, ordered
from .sources.tables import holds, observations, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HOUR, DAY = 3600.0, 86400.0
OBS = """obs AS (SELECT user_id AS track, event_id AS id, epoch(ts) AS t, value AS x, CAST(json_extract_string(props, '$.k') AS INTEGER) AS y, event_type AS kind FROM events)"""
HOLDS = """holds AS (SELECT l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, epoch(l_shipdate) AS t, CASE WHEN l_linestatus = 'O' THEN l_quantity * 86400 ELSE 0.0 END AS duration, l_returnflag = 'R' AS fake, l_discount AS ring, l_tax AS head, l_quantity AS frames, l_extendedprice AS price FROM lineitem)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r(c, n: int = 4):
    return F.round(c, n)


def w(*order: str):
    return Window.partitionBy("track").orderBy(*(order or ("t", "id")))


@query("q01_sessions_gap_islands", """
WITH d AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL '10' HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM d)
SELECT user_id, CAST(k AS BIGINT) AS session_no, count(*) AS n, min(ts) AS t0, max(ts) AS t1, round(sum(value), 4) AS total FROM g GROUP BY user_id, k""")
def q01(spark, d):
    e = table(spark, d, "events")
    late = F.col("ts") > F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")) + F.expr("INTERVAL 10 HOURS")
    s = ordered.islands(e, ["user_id"], ["ts", "event_id"], late, "session_no")
    return s.groupBy("user_id", "session_no").agg(F.count("*").alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1"), r(F.sum("value")).alias("total"))


@query("q02_session_window_counts", """
WITH d AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL '10' HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM d)
SELECT user_id, min(ts) AS t0, count(*) AS n FROM g GROUP BY user_id, k""")
def q02(spark, d):
    from .streaming.sessions import sessions

    return sessions(table(spark, d, "events"), "10 hours")


@query("q03_tumbling_calibration", f"""
WITH {OBS}, g AS (SELECT median(x) AS nominal, CAST(min(floor(t / 28800)) AS BIGINT) AS a, CAST(max(floor(t / 28800)) AS BIGINT) AS b FROM obs),
m AS (SELECT CAST(floor(t / 28800) AS BIGINT) AS bucket, median(x) AS med, count(*) AS n FROM obs GROUP BY 1),
d AS (SELECT m.bucket, median(abs(x - med)) AS mad FROM obs JOIN m ON CAST(floor(t / 28800) AS BIGINT) = m.bucket GROUP BY 1),
s AS (SELECT unnest(generate_series(a, b)) AS bucket, nominal FROM g)
SELECT s.bucket, CAST(coalesce(n, 0) AS BIGINT) AS n, round(CASE WHEN n > 4 THEN med ELSE nominal END, 4) AS med, round(coalesce(mad, 0), 4) AS mad
FROM s LEFT JOIN m USING (bucket) LEFT JOIN d USING (bucket)""")
def q03(spark, d):
    from .plans.calibration import tumbling

    return tumbling(observations(spark, d), 8 * HOUR)


@query("q04_hist_mode_judge", f"""
WITH {OBS}, h AS (SELECT CAST(round_even(y / 2, 0) AS BIGINT) AS bin, count(*) AS n FROM obs WHERE y >= 10 GROUP BY 1)
SELECT bin * 2 AS judge, n FROM h ORDER BY n DESC, bin LIMIT 1""")
def q04(spark, d):
    h = observations(spark, d).where("y >= 10").groupBy(F.rint(F.col("y") / 2).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return h.agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("bin"), F.max("n").alias("n")).select((F.col("bin") * 2).alias("judge"), "n")


@query("q05_median_mad_speed", f"""
WITH {OBS}, s AS (SELECT track, abs(x - lag(x) OVER q) / (t - lag(t) OVER q) * 3600 AS v FROM obs WINDOW q AS (PARTITION BY track ORDER BY t, id)),
f AS (SELECT * FROM s WHERE v > 0.5 AND v < 500), m AS (SELECT track, median(v) AS med, count(*) AS n FROM f GROUP BY track)
SELECT track, n, round(any_value(med), 4) AS med, round(median(abs(v - med)), 4) AS mad FROM f JOIN m USING (track) GROUP BY track, n""")
def q05(spark, d):
    s = observations(spark, d).withColumn("v", F.abs(F.col("x") - F.lag("x").over(w())) / (F.col("t") - F.lag("t").over(w())) * 3600).where("v > 0.5 AND v < 500")
    m = s.groupBy("track").agg(F.expr("percentile(v, 0.5)").alias("med"), F.count("*").alias("n"))
    return s.join(m, "track").groupBy("track", "n").agg(r(F.first("med")).alias("med"), r(F.expr("percentile(abs(v - med), 0.5)")).alias("mad"))


@query("q06_track_min_length", f"""
WITH {OBS} SELECT track, count(*) AS n, max(y) - min(y) AS extent FROM obs GROUP BY track HAVING count(*) >= 60 AND max(y) - min(y) >= 95""")
def q06(spark, d):
    return observations(spark, d).groupBy("track").agg(F.count("*").alias("n"), (F.max("y") - F.min("y")).alias("extent")).where("n >= 60 AND extent >= 95")


@query("q07_decimate_lastn", f"""
WITH {OBS}, k AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY t, id) AS a, row_number() OVER (PARTITION BY track ORDER BY t DESC, id DESC) AS b FROM obs)
SELECT track, id, a % 2 = 1 AS kept, b <= 5 AS tail FROM k WHERE a % 2 = 1 OR b <= 5""")
def q07(spark, d):
    o = observations(spark, d).withColumn("a", F.row_number().over(w())).withColumn("b", F.row_number().over(Window.partitionBy("track").orderBy(F.desc("t"), F.desc("id"))))
    return o.where("a % 2 = 1 OR b <= 5").select("track", "id", (F.col("a") % 2 == 1).alias("kept"), (F.col("b") <= 5).alias("tail"))


@query("q08_lag2_velocity", f"""
WITH {OBS} SELECT track, id, round(CASE WHEN lag(x, 2) OVER q IS NULL THEN 0 ELSE least(greatest((x - lag(x, 2) OVER q) / (t - lag(t, 2) OVER q) * 3600, -90), 90) END, 5) AS v,
round(coalesce((x - first_value(x) OVER f) / nullif(t - first_value(t) OVER f, 0) * 3600, 0), 5) AS trailing
FROM obs WINDOW q AS (PARTITION BY track ORDER BY t, id), f AS (PARTITION BY track ORDER BY t, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def q08(spark, d):
    f = w().rowsBetween(-4, 0)
    v = clip((F.col("x") - F.lag("x", 2).over(w())) / (F.col("t") - F.lag("t", 2).over(w())) * 3600, -90.0, 90.0)
    tr = (F.col("x") - F.first("x").over(f)) / F.nullif(F.col("t") - F.first("t").over(f), F.lit(0.0)) * 3600
    v = F.when(F.lag("x", 2).over(w()).isNull(), 0.0).otherwise(v)
    return observations(spark, d).select("track", "id", r(v, 5).alias("v"), r(F.coalesce(tr, F.lit(0.0)), 5).alias("trailing"))


@query("q09_regression_contact", f"""
WITH {OBS}, k AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY t DESC, id DESC) AS b, max(t) OVER (PARTITION BY track) AS m FROM obs),
g AS (SELECT track, regr_slope(y, (t - m) / 3600) AS s, regr_intercept(y, (t - m) / 3600) AS i, count(*) AS n FROM k WHERE b <= 12 GROUP BY track)
SELECT track, n, round(s, 6) AS slope, round(i, 4) AS at_end, round((50 - i) / s, 2) AS contact FROM g WHERE abs(s) > 0.02""")
def q09(spark, d):
    o = observations(spark, d).withColumn("b", F.row_number().over(Window.partitionBy("track").orderBy(F.desc("t"), F.desc("id")))).withColumn("m", F.max("t").over(Window.partitionBy("track")))
    g = o.where("b <= 12").groupBy("track").agg(F.expr("regr_slope(y, (t - m) / 3600)").alias("s"), F.expr("regr_intercept(y, (t - m) / 3600)").alias("i"), F.count("*").alias("n"))
    return g.where("abs(s) > 0.02").select("track", "n", r(F.col("s"), 6).alias("slope"), r(F.col("i")).alias("at_end"), r((50 - F.col("i")) / F.col("s"), 2).alias("contact"))


ISL = "sum(CASE WHEN kind IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY t, id ROWS UNBOUNDED PRECEDING)"


@query("q10_value_run_islands", f"""
WITH {OBS}, l AS (SELECT *, lag(kind) OVER (PARTITION BY track ORDER BY t, id) AS p FROM obs), g AS (SELECT *, {ISL} AS k FROM l)
SELECT track, CAST(k AS BIGINT) AS run, any_value(kind) AS kind, count(*) AS n, round(min(t), 3) AS t0, round(max(t), 3) AS t1, max(t) - min(t) > 7200 AS plateau FROM g GROUP BY track, k""")
def q10(spark, d):
    g = ordered.value_islands(observations(spark, d), ["track"], ["t", "id"], "kind", "run")
    return g.groupBy("track", "run").agg(F.first("kind").alias("kind"), F.count("*").alias("n"), r(F.min("t"), 3).alias("t0"), r(F.max("t"), 3).alias("t1"), (F.max("t") - F.min("t") > 7200).alias("plateau"))


@query("q11_transition_windows", f"""
WITH {OBS}, k AS (SELECT track, id, t, y, lag(t) OVER q AS t0, lag(y) OVER q AS y0 FROM obs WHERE (x / 1000 < 0.085 AND y / 1000.0 > 0.025) OR (x / 1000 < 0.045 AND y / 1000.0 > 0.02) WINDOW q AS (PARTITION BY track ORDER BY t, id))
SELECT track, id, y - y0 AS rise, round(t - t0, 3) AS gap, round(least(57600, greatest(21600, 0.5 * (t - t0) + 10800)), 3) AS tolerance FROM k WHERE y > y0""")
def q11(spark, d):
    error, margin = F.col("x") / 1000, F.col("y") / 1000
    k = observations(spark, d).where(reliable(error, margin)).withColumn("t0", F.lag("t").over(w())).withColumn("y0", F.lag("y").over(w())).where("y > y0")
    gap = F.col("t") - F.col("t0")
    return k.select("track", "id", (F.col("y") - F.col("y0")).alias("rise"), r(gap, 3).alias("gap"), r(clip(0.5 * gap + 10800, 21600.0, 57600.0), 3).alias("tolerance"))


@query("q12_longest_run", f"""
WITH {OBS}, e AS (SELECT *, lag(t) OVER (PARTITION BY track ORDER BY t, id) AS p FROM obs WHERE y > 50),
g AS (SELECT track, sum(CASE WHEN p IS NULL OR t - p > 36000 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS k FROM e),
n AS (SELECT track, k, count(*) AS n FROM g GROUP BY track, k)
SELECT track, max(n) AS longest, max(n) >= 3 AS triggers FROM n GROUP BY track""")
def q12(spark, d):
    n = ordered.gap_islands(observations(spark, d).where("y > 50"), ["track"], "t", 10 * HOUR, "id").groupBy("track", "island").count()
    return n.groupBy("track").agg(F.max("count").alias("longest"), (F.max("count") >= 3).alias("triggers"))


@query("q13_median_filter3", f"""
WITH {OBS}, k AS (SELECT track, id, x, coalesce(lag(x) OVER q, x) AS a, coalesce(lead(x) OVER q, x) AS b FROM obs WINDOW q AS (PARTITION BY track ORDER BY t, id))
SELECT track, id, list_sort([a, x, b])[2] AS filtered FROM k""")
def q13(spark, d):
    return ordered.median_filter(observations(spark, d), ["track"], ["t", "id"], "x").select("track", "id", "filtered")


@query("q14_angle_unwrap", f"""
WITH {OBS}, a AS (SELECT track, id, t, y * 3.5 AS deg, y * 3.5 - lag(y * 3.5) OVER (PARTITION BY track ORDER BY t, id) AS st FROM obs),
s AS (SELECT *, coalesce((((st + 180) % 360) + 360) % 360 - 180, 0) AS stp FROM a)
SELECT track, id, round(first_value(deg) OVER (PARTITION BY track ORDER BY t, id) + sum(stp) OVER (PARTITION BY track ORDER BY t, id ROWS UNBOUNDED PRECEDING), 4)::DOUBLE AS unwrapped FROM s""")
def q14(spark, d):
    o = observations(spark, d).withColumn("deg", F.col("y") * 3.5)
    return ordered.unwrap(o, ["track"], ["t", "id"], "deg").select("track", "id", r(F.col("unwrapped").cast("double")).alias("unwrapped"))


@query("q15_persistence_lead", f"""
WITH {OBS}, k AS (SELECT track, id, kind, lead(kind) OVER q AS nk, lead(t) OVER q - t AS dt FROM obs WINDOW q AS (PARTITION BY track ORDER BY t, id))
SELECT track, id, kind FROM k WHERE nk = kind AND dt < 21600""")
def q15(spark, d):
    return observations(spark, d).withColumn("nk", F.lead("kind").over(w())).withColumn("dt", F.lead("t").over(w()) - F.col("t")).where("nk = kind AND dt < 21600").select("track", "id", "kind")


@query("q16_freshness", f"""
WITH {OBS} SELECT a.track, a.id, round(a.x - 0.95 * coalesce(max(b.x), 0), 4) AS fresh FROM obs a LEFT JOIN obs b ON a.track = b.track AND b.t < a.t AND b.t >= a.t - 172800 AND abs(a.y - b.y) <= 20 GROUP BY a.track, a.id, a.x""")
def q16(spark, d):
    o = observations(spark, d)
    near = joins.band_join(o.select("track", "id", "t", "y"), o.select("track", "t", "x", "y"), ["track"], "t", -2 * DAY, 0.0).where("t_r < t AND abs(y - y_r) <= 20").groupBy("track", "id").agg(F.max("x_r").alias("m"))
    return o.join(near, ["track", "id"], "left").select("track", "id", r(F.col("x") - 0.95 * F.coalesce("m", F.lit(0.0))).alias("fresh"))


@query("q17_asof_prev", f"""
WITH {OBS}, p AS (SELECT * FROM obs WHERE kind = 'purchase'), v AS (SELECT track, t, max(id) AS id FROM obs WHERE kind = 'view' GROUP BY track, t)
SELECT p.track, p.id, v.id AS view_id, round(p.t - v.t, 3) AS age FROM p ASOF LEFT JOIN v ON p.track = v.track AND p.t >= v.t""")
def q17(spark, d):
    o = observations(spark, d)
    j = joins.as_of(o.where("kind = 'purchase'"), o.where("kind = 'view'"), ["track"], "t", ["id"])
    return j.select("track", "id", F.col("id_r").alias("view_id"), r(F.col("t") - F.col("t_r"), 3).alias("age"))


@query("q18_asof_nearest_tol", f"""
WITH {OBS}, p AS (SELECT * FROM obs WHERE kind = 'purchase'), v AS (SELECT * FROM obs WHERE kind = 'click'),
c AS (SELECT p.track, p.id, v.id AS click_id, v.t - p.t AS dt, row_number() OVER (PARTITION BY p.track, p.id ORDER BY abs(v.t - p.t), v.t, v.id) AS k FROM p JOIN v ON p.track = v.track AND abs(v.t - p.t) <= 43200)
SELECT track, id, click_id, round(dt, 3) AS dt FROM c WHERE k = 1""")
def q18(spark, d):
    o = observations(spark, d)
    j = joins.band_join(o.where("kind = 'purchase'").select("track", "id", "t"), o.where("kind = 'click'").select("track", "id", "t"), ["track"], "t", -12 * HOUR, 12 * HOUR)
    j = joins.argmin_per(j.withColumn("dt", F.col("t_r") - F.col("t")), ["track", "id"], F.abs("dt"), "t_r", "id_r")
    return j.select("track", "id", F.col("id_r").alias("click_id"), r(F.col("dt"), 3).alias("dt"))


@query("q19_band_contact", f"""
WITH {OBS}, n AS (SELECT * FROM obs WHERE kind = 'view'), g AS (SELECT * FROM obs WHERE kind = 'purchase'),
c AS (SELECT n.track, n.id, g.id AS target, (g.t - n.t) / 3600 AS jump, abs(g.y - n.y) AS residual FROM n JOIN g ON n.track = g.track AND g.t - n.t >= -7200 AND g.t - n.t <= 50400 WHERE abs(g.y - n.y) <= 40),
k AS (SELECT *, row_number() OVER (PARTITION BY track, id ORDER BY round(residual + 8 * abs(jump) + 2 * greatest(0, jump), 6), target) AS k FROM c)
SELECT track, id, target, round(jump, 4) AS jump, residual FROM k WHERE k = 1""")
def q19(spark, d):
    o = observations(spark, d)
    j = joins.band_join(o.where("kind = 'view'").select("track", "id", "t", "y"), o.where("kind = 'purchase'").select("track", "id", "t", "y"), ["track"], "t", -2 * HOUR, 14 * HOUR)
    j = j.withColumn("jump", (F.col("t_r") - F.col("t")) / 3600).withColumn("residual", F.abs(F.col("y_r") - F.col("y"))).where("residual <= 40")
    j = joins.argmin_per(j, ["track", "id"], r(F.col("residual") + 8 * F.abs("jump") + 2 * F.greatest(F.lit(0.0), F.col("jump")), 6), "id_r")
    return j.select("track", "id", F.col("id_r").alias("target"), r(F.col("jump")).alias("jump"), "residual")


@query("q20_band_argmin_snap", f"""
WITH {OBS}, f AS (SELECT *, CAST(round_even(t / 3600, 0) AS BIGINT) AS frame FROM obs),
c AS (SELECT a.track, a.id, b.id AS other, row_number() OVER (PARTITION BY a.track, a.id ORDER BY abs(a.y - b.y) + 40 * abs(a.frame - b.frame), b.id) AS k FROM f a JOIN f b ON a.track = b.track AND a.id <> b.id AND abs(a.frame - b.frame) <= 2)
SELECT track, id, other FROM c WHERE k = 1""")
def q20(spark, d):
    f = observations(spark, d).select("track", "id", "y", F.rint(F.col("t") / 3600).cast("long").alias("frame"))
    j = joins.band_join(f, f, ["track"], "frame", -2, 2).where("id <> id_r")
    return joins.argmin_per(j, ["track", "id"], F.abs(F.col("y") - F.col("y_r")) + 40 * F.abs(F.col("frame") - F.col("frame_r")), "id_r").select("track", "id", F.col("id_r").alias("other"))


CELLS = "CAST(round_even(t / 7200, 0) AS BIGINT) AS a, CAST(round_even(x / 4, 0) AS BIGINT) AS b, CAST(round_even(y / 4, 0) AS BIGINT) AS c"


@query("q21_grid_semi", f"""
WITH {OBS}, n AS (SELECT track, id, {CELLS} FROM obs WHERE kind = 'view'), g AS (SELECT {CELLS} FROM obs WHERE kind = 'click')
SELECT track, id FROM n WHERE EXISTS (SELECT 1 FROM g WHERE abs(n.a - g.a) <= 1 AND abs(n.b - g.b) <= 1 AND abs(n.c - g.c) <= 1)""")
def q21(spark, d):
    o = observations(spark, d)
    return joins.grid_semi(o.where("kind = 'view'"), o.where("kind = 'click'"), {"t": 7200.0, "x": 4.0, "y": 4.0}).select("track", "id")


@query("q22_anti_unrepresented", f"""
WITH {OBS} SELECT track, id FROM obs n WHERE kind = 'error' AND NOT EXISTS (SELECT 1 FROM obs g WHERE g.kind = 'view' AND g.track = n.track AND abs(g.t - n.t) <= 86400 AND abs(g.y - n.y) <= 18)""")
def q22(spark, d):
    o = observations(spark, d)
    e = o.where("kind = 'error'").select("track", "id", "t", "y")
    hit = joins.band_join(e, o.where("kind = 'view'").select("track", "t", "y"), ["track"], "t", -DAY, DAY).where("abs(y - y_r) <= 18").select("track", "id").distinct()
    return e.join(hit, ["track", "id"], "left_anti").select("track", "id")


SPAN = "s AS (SELECT track, min(t) AS lo, max(t) AS hi FROM obs GROUP BY track), ce AS (SELECT DISTINCT track, floor(t / 3600) AS f, floor(x / 10) AS g FROM obs), cp AS (SELECT m.track AS a, n.track AS b FROM ce m JOIN ce n ON m.f = n.f AND m.g = n.g AND m.track < n.track GROUP BY m.track, n.track HAVING count(*) >= 2), pr AS (SELECT a.track AS a, b.track AS b, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM cp JOIN s a ON a.track = cp.a JOIN s b ON b.track = cp.b WHERE least(a.hi, b.hi) - greatest(a.lo, b.lo) >= 86400), g AS (SELECT a, b, k, lo + (hi - lo) * k / 4 AS t FROM pr, (SELECT unnest(generate_series(0, 4)) AS k))"
LERP = "CASE WHEN p.t IS NULL THEN q.x WHEN q.t IS NULL OR q.t = p.t THEN p.x ELSE p.x + (q.x - p.x) * (g.t - p.t) / (q.t - p.t) END"


@query("q23_overlap_resample", f"""
WITH {OBS}, o AS (SELECT track, t, max(x) AS x FROM obs GROUP BY track, t), {SPAN},
va AS (SELECT g.a, g.b, g.k, {LERP} AS v FROM g ASOF LEFT JOIN o p ON p.track = g.a AND g.t >= p.t ASOF LEFT JOIN o q ON q.track = g.a AND g.t <= q.t),
vb AS (SELECT g.a, g.b, g.k, {LERP} AS v FROM g ASOF LEFT JOIN o p ON p.track = g.b AND g.t >= p.t ASOF LEFT JOIN o q ON q.track = g.b AND g.t <= q.t)
SELECT a, b, round(median(abs(va.v - vb.v)), 3) AS med, round(max(abs(va.v - vb.v)), 3) AS worst FROM va JOIN vb USING (a, b, k) GROUP BY a, b""")
def q23(spark, d):
    from .plans.paths import overlap_distance

    d = overlap_distance(observations(spark, d), {"t": HOUR, "x": 10.0}, 2, DAY, 5)
    return d.select("a", "b", r(F.col("med"), 3).alias("med"), r(F.col("worst"), 3).alias("worst"))


@query("q24_interp_align", f"""
WITH {OBS}, o AS (SELECT track, t, max(x) AS x FROM obs WHERE kind = 'view' GROUP BY track, t), g AS (SELECT track, id, t FROM obs WHERE kind = 'purchase'),
c AS (SELECT g.track, g.id, {LERP} AS v FROM g ASOF LEFT JOIN o p ON p.track = g.track AND g.t >= p.t ASOF LEFT JOIN o q ON q.track = g.track AND g.t <= q.t)
SELECT track, id, round(v, 4) AS aligned FROM c WHERE v IS NOT NULL""")
def q24(spark, d):
    o = observations(spark, d)
    p = o.where("kind = 'view'").groupBy("track", "t").agg(F.max("x").alias("x"))
    return ordered.interpolate(p, o.where("kind = 'purchase'").select("track", "id", "t")).where("interpolated IS NOT NULL").select("track", "id", r(F.col("interpolated")).alias("aligned"))


@query("q25_close_pairs", f"""
WITH {OBS} SELECT a.track, a.id AS first, b.id AS second, round(b.t - a.t, 3) AS gap FROM obs a JOIN obs b ON a.track = b.track AND b.t - a.t >= 600 AND b.t - a.t <= 7200 AND abs(a.y - b.y) <= 65 AND a.kind <> b.kind""")
def q25(spark, d):
    o = observations(spark, d).select("track", "id", "t", "y", "kind")
    j = joins.band_join(o, o, ["track"], "t", 600.0, 7200.0).where("abs(y - y_r) <= 65 AND kind <> kind_r")
    return j.select("track", F.col("id").alias("first"), F.col("id_r").alias("second"), r(F.col("t_r") - F.col("t"), 3).alias("gap"))


BOUNDS = "b AS (SELECT k, min(t) AS lo, lead(min(t)) OVER (ORDER BY k) AS hi FROM (SELECT t, CAST(floor(t / 43200) AS BIGINT) AS k FROM obs) GROUP BY k)"
COUNTS = f"c AS (SELECT b.k, b.lo, b.hi, count(o.id) AS n FROM b LEFT JOIN obs o ON o.t > b.lo AND o.t <= b.hi AND o.kind = 'click' WHERE b.hi IS NOT NULL GROUP BY b.k, b.lo, b.hi)"


@query("q26_interval_assign", f"WITH {OBS}, {BOUNDS}, {COUNTS} SELECT k AS interval_no, round(lo, 3) AS lo, round(hi, 3) AS hi, n FROM c")
def q26(spark, d):
    from .plans.counters import day_intervals, interval_counts

    o = observations(spark, d)
    return interval_counts(day_intervals(o), o.where("kind = 'click'").select("t")).select("interval_no", r(F.col("lo"), 3).alias("lo"), r(F.col("hi"), 3).alias("hi"), "n")


@query("q27_interval_residual_audit", f"""
WITH {OBS}, {BOUNDS}, {COUNTS}, v AS (SELECT b.k, count(o.id) AS e FROM b LEFT JOIN obs o ON o.t > b.lo AND o.t <= b.hi AND o.kind = 'view' WHERE b.hi IS NOT NULL GROUP BY b.k)
SELECT count(*) AS intervals, CAST(sum(abs(e - n)) AS BIGINT) AS unresolved, count(*) FILTER (e = n) AS exact, count(*) FILTER (e = 0 AND n = 0) AS quiet, CAST(max(abs(e - n)) AS BIGINT) AS worst FROM c JOIN v USING (k)""")
def q27(spark, d):
    from .plans.counters import audit, day_intervals, interval_counts

    o = observations(spark, d)
    i = day_intervals(o)
    return audit(interval_counts(i, o.where("kind = 'view'").select("t")), interval_counts(i, o.where("kind = 'click'").select("t")))


@query("q28_running_curve_loss", f"""
WITH {OBS}, c AS (SELECT track, id, t, y, row_number() OVER (PARTITION BY track ORDER BY t, id) AS n, sum(CASE WHEN kind IN ('click', 'view') THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS seen, least(1, greatest(0.15, (y / 100.0 - 0.015) / 0.075)) AS weight FROM obs)
SELECT track, round(sum(weight * abs(n - seen)), 4) AS loss, round(avg(CASE WHEN n = seen THEN 1.0 ELSE 0.0 END), 5) AS exact FROM c GROUP BY track""")
def q28(spark, d):
    from .plans.counters import curve_loss

    return curve_loss(observations(spark, d))


@query("q29_cumulative_audit", f"""
WITH {HOLDS}, a AS (SELECT t FROM holds WHERE NOT fake UNION ALL SELECT t + duration FROM holds WHERE NOT fake AND duration > 0),
n AS (SELECT CAST(floor(t / 2592000) AS BIGINT) AS month, count(*) AS atoms FROM a GROUP BY 1)
SELECT month, atoms, CAST(sum(atoms) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM n""")
def q29(spark, d):
    from .plans.counters import atoms

    n = atoms(holds(spark, d)).groupBy(F.floor(F.col("t") / (30 * DAY)).alias("month")).agg(F.count("*").alias("atoms"))
    return n.withColumn("total", F.sum("atoms").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)))  # one row a month


@query("q30_atoms_explode", f"""
WITH {HOLDS}, a AS (SELECT ok, ln, t FROM holds WHERE NOT fake UNION ALL SELECT ok, ln, t + duration FROM holds WHERE NOT fake AND duration > 0)
SELECT ok, count(*) AS atoms, round(min(t), 1) AS first, round(max(t), 1) AS last FROM a GROUP BY ok""")
def q30(spark, d):
    from .plans.counters import atoms

    return atoms(holds(spark, d)).groupBy("ok").agg(F.count("*").alias("atoms"), r(F.min("t"), 1).alias("first"), r(F.max("t"), 1).alias("last"))


NMS = f"""
WITH {OBS}, l AS (SELECT track, list({{'t': t, 'id': id, 'y': y}} ORDER BY t, id) AS v FROM obs GROUP BY track),
f AS (SELECT track, list_reduce(list_transform(v, lambda e: [e]), lambda acc, e: CASE WHEN len(list_filter(acc, lambda q: abs(q.t - e[1].t) < 21600 AND abs(q.y - e[1].y) < 38)) > 0 THEN acc ELSE list_concat(acc, e) END) AS k FROM l)
SELECT track, u.id AS id FROM (SELECT track, unnest(k) AS u FROM f)"""


def _near(q, e):
    return (F.abs(q["t"] - e["t"]) < 6 * HOUR) & (F.abs(q["y"] - e["y"]) < 38)


@query("q31_nms_greedy", NMS)
def q31(spark, d):
    return greedy.suppress(observations(spark, d), "track", ["t", "id"], ["y"], _near).select("track", "id")


@query("q32_nms_islands", NMS)
def q32(spark, d):
    return greedy.suppress(observations(spark, d), "track", ["t", "id"], ["y"], _near, reach=6 * HOUR).select("track", "id")


@query("q33_monotone_anchors", f"""
WITH {OBS}, l AS (SELECT track, list({{'t': t, 'id': id, 'y': y}} ORDER BY t, id) AS v FROM obs GROUP BY track),
f AS (SELECT track, list_reduce(list_transform(v, lambda e: [e]), lambda acc, e: CASE WHEN e[1].y >= acc[-1].y AND e[1].y - acc[-1].y <= 0.0004 * (e[1].t - acc[-1].t) + 10 THEN list_concat(acc, e) ELSE acc END) AS k FROM l)
SELECT track, u.id AS id, u.y AS y FROM (SELECT track, unnest(k) AS u FROM f)""")
def q33(spark, d):
    ok = lambda q, e: (e["y"] >= q["y"]) & (e["y"] - q["y"] <= 0.0004 * (e["t"] - q["t"]) + 10)
    return greedy.monotone(observations(spark, d), ["track"], ["t", "id"], ["y"], ok).select("track", "id", "y")


@query("q34_dense_anchor_grid", f"""
WITH {OBS}, g AS (SELECT track, unnest(generate_series(CAST(ceil(min(t) / 86400) AS BIGINT), CAST(floor(max(t) / 86400) AS BIGINT))) AS day FROM obs GROUP BY track),
c AS (SELECT g.track, g.day, o.id, row_number() OVER (PARTITION BY g.track, g.day ORDER BY abs(o.t - g.day * 86400), o.id) AS k FROM g JOIN obs o ON o.track = g.track AND abs(o.t - g.day * 86400) <= 15552)
SELECT track, day, id FROM c WHERE k = 1""")
def q34(spark, d):
    o = observations(spark, d)
    g = o.groupBy("track").agg(F.explode(F.sequence(F.ceil(F.min("t") / DAY), F.floor(F.max("t") / DAY))).alias("day")).withColumn("t", F.col("day") * DAY)
    j = joins.band_join(g, o.select("track", "id", "t"), ["track"], "t", -0.18 * DAY, 0.18 * DAY)
    return joins.argmin_per(j, ["track", "day"], F.abs(F.col("t_r") - F.col("t")), "id_r").select("track", "day", F.col("id_r").alias("id"))


@query("q35_slot_pool", f"""
WITH {OBS}, l AS (SELECT track, list({{'ends': [t + x * 600], 'out': [{{'id': id, 'slot': 0}}], 's': t, 'e': t + x * 600, 'i': id}} ORDER BY t, id) AS v FROM obs GROUP BY track),
f AS (SELECT track, list_reduce(v, lambda a, z: {{'ends': CASE WHEN coalesce(list_position(list_transform(a.ends, lambda q: q + 0.001 < z.s), true), 0) > 0 THEN list_concat(list_concat(a.ends[1:list_position(list_transform(a.ends, lambda q: q + 0.001 < z.s), true) - 1], [z.e]), a.ends[list_position(list_transform(a.ends, lambda q: q + 0.001 < z.s), true) + 1:]) ELSE list_append(a.ends, z.e) END,
'out': list_append(a.out, {{'id': z.i, 'slot': CAST(CASE WHEN coalesce(list_position(list_transform(a.ends, lambda q: q + 0.001 < z.s), true), 0) > 0 THEN list_position(list_transform(a.ends, lambda q: q + 0.001 < z.s), true) - 1 ELSE len(a.ends) END AS INTEGER)}}), 's': z.s, 'e': z.e, 'i': z.i}}) AS r FROM l)
SELECT track, u.id AS id, u.slot AS slot FROM (SELECT track, unnest(r.out) AS u FROM f)""")
def q35(spark, d):
    o = observations(spark, d).withColumn("end", F.col("t") + F.col("x") * 600)
    return greedy.slots(o, ["track"], "t", "end", "id", 0.001)


@query("q36_peaks_min_sep", f"""
WITH {OBS}, h AS (SELECT kind, y AS bin, count(*) AS n FROM obs GROUP BY kind, y), l AS (SELECT kind, list({{'o': -n, 'bin': bin}} ORDER BY -n, bin) AS v FROM h WHERE n >= 5 GROUP BY kind),
f AS (SELECT kind, list_reduce(list_transform(v, lambda e: [e]), lambda acc, e: CASE WHEN len(list_filter(acc, lambda q: abs(q.bin - e[1].bin) < 12)) > 0 THEN acc ELSE list_concat(acc, e) END) AS k FROM l)
SELECT kind, u.bin AS bin, CAST(-u.o AS BIGINT) AS n FROM (SELECT kind, unnest(k) AS u FROM f)""")
def q36(spark, d):
    h = observations(spark, d).groupBy("kind", F.col("y").alias("bin")).agg((-F.count("*")).alias("o")).where("o <= -5")
    return greedy.suppress(h, "kind", ["o", "bin"], [], lambda q, e: F.abs(q["bin"] - e["bin"]) < 12).select("kind", "bin", (-F.col("o")).alias("n"))


PROTO = "p AS (SELECT label, i, median(v) AS m FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i)"


@query("q37_template_prototype", f"WITH {PROTO} SELECT label, i, round(m, 5) AS m, m >= 0 AS bit FROM p")
def q37(spark, d):
    from .plans.templates import prototypes

    return prototypes(table(spark, d, "embeddings")).select("label", "i", r(F.col("m"), 5).alias("m"), (F.col("m") >= 0).alias("bit"))


ERR = f"WITH {PROTO}, e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT vec_id, label, avg((v - m) * (v - m)) AS err FROM e JOIN p USING (i) GROUP BY vec_id, label), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(err, 6), label) AS k FROM s)"


@query("q38_nearest_template", f"{ERR} SELECT vec_id, label AS best, round(err, 4) AS err FROM k WHERE k = 1")
def q38(spark, d):
    from .plans.templates import classify

    return classify(table(spark, d, "embeddings")).select("vec_id", "best", r(F.col("err")).alias("err"))


@query("q39_margin_second_best", f"{ERR} SELECT vec_id, round(max(err) FILTER (k = 2) - max(err) FILTER (k = 1), 4) AS margin FROM k GROUP BY vec_id")
def q39(spark, d):
    from .plans.templates import classify

    return classify(table(spark, d, "embeddings")).select("vec_id", r(F.col("margin")).alias("margin"))


@query("q40_evidence_score_topk", f"""
WITH {HOLDS}, s AS (SELECT ok, ln, pk, price, t, round(5 * ring + 3 * head + 4 * ring * head + 1.3 * CASE WHEN pk % 3 = 0 THEN 1 ELSE 0 END + least(2, 0.34 * ln(1 + frames)) + 0.8 * CASE WHEN frames >= 5 THEN 1 ELSE 0 END - 1.8 * CASE WHEN fake THEN 1 ELSE 0 END, 6) AS score FROM holds)
SELECT ok, ln, score, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY CAST(floor(t / 2592000) AS BIGINT) ORDER BY score DESC, ok, ln, pk, price) AS k FROM s) WHERE k <= 8""")
def q40(spark, d):
    h = holds(spark, d)
    s = h.withColumn("score", r(evidence_score(F.col("ring"), F.col("head"), F.col("ring") * F.col("head"), F.col("pk") % 3 == 0, F.col("frames"), F.col("frames"), F.col("fake")), 6))
    k = F.row_number().over(Window.partitionBy(F.floor(F.col("t") / (30 * DAY))).orderBy(F.desc("score"), "ok", "ln", "pk", "price"))
    return s.withColumn("k", k).where("k <= 8").select("ok", "ln", "score", "k")


@query("q41_union_pass_tag", f"""
WITH {OBS}, u AS (SELECT 245 AS pass, id, t, x FROM obs WHERE x > 60 UNION ALL SELECT 160, id, t, x FROM obs WHERE x > 40 UNION ALL SELECT 80, id, t, x FROM obs WHERE x > 20)
SELECT id, count(*) AS passes, max(pass) AS strictest FROM u GROUP BY id""")
def q41(spark, d):
    o = observations(spark, d).select("id", "t", "x")
    u = o.where("x > 60").withColumn("pass", F.lit(245)).unionByName(o.where("x > 40").withColumn("pass", F.lit(160))).unionByName(o.where("x > 20").withColumn("pass", F.lit(80)))
    return u.groupBy("id").agg(F.count("*").alias("passes"), F.max("pass").alias("strictest"))


@query("q42_keyed_union_setdefault", f"""
WITH {OBS}, u AS (SELECT track, CAST(round_even(t / 3600, 0) AS BIGINT) AS frame, x, id, 0 AS o FROM obs WHERE kind = 'view' UNION ALL SELECT track, CAST(round_even(t / 3600, 0) AS BIGINT), x, id, 1 FROM obs WHERE kind = 'click')
SELECT track, frame, x, o = 1 AS filled FROM (SELECT *, row_number() OVER (PARTITION BY track, frame ORDER BY o, id) AS k FROM u) WHERE k = 1""")
def q42(spark, d):
    o = observations(spark, d).withColumn("frame", F.rint(F.col("t") / 3600).cast("long")).select("track", "frame", "x", "id", "kind")
    u = o.where("kind = 'view'").withColumn("o", F.lit(0)).union(o.where("kind = 'click'").withColumn("o", F.lit(1)))
    return joins.argmin_per(u, ["track", "frame"], F.col("o"), "id").select("track", "frame", "x", (F.col("o") == 1).alias("filled"))


@query("q43_prune_noise", f"""
WITH {HOLDS} SELECT ok, ln, CASE WHEN fake AND (frames < 6 OR (duration > 0 AND duration < 864000) OR price < 5000) AND ring < 0.05 THEN 'removed' ELSE 'kept' END AS verdict FROM holds""")
def q43(spark, d):
    noise = F.expr("fake AND (frames < 6 OR (duration > 0 AND duration < 864000) OR price < 5000) AND ring < 0.05")
    return holds(spark, d).select("ok", "ln", F.when(noise, "removed").otherwise("kept").alias("verdict"))


@query("q44_type_vote", f"""
WITH {OBS} SELECT track, median(CASE WHEN kind = 'click' THEN 1 ELSE 0 END) >= 0.5 AS drag, coalesce(round(median(CASE WHEN y > 50 THEN x END), 4), -1) AS body FROM obs GROUP BY track""")
def q44(spark, d):
    return observations(spark, d).groupBy("track").agg((F.expr("percentile(CASE WHEN kind = 'click' THEN 1 ELSE 0 END, 0.5)") >= 0.5).alias("drag"), F.coalesce(r(F.expr("percentile(CASE WHEN y > 50 THEN x END, 0.5)")), F.lit(-1.0)).alias("body"))


@query("q45_hash_memo", """SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first, any_value(length(text)) AS chars FROM documents GROUP BY sha256(text)""")
def q45(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.first(F.length("text")).cast("long").alias("chars"))


@query("q46_slug", """WITH s AS (SELECT page_id, regexp_replace(regexp_replace(url, '[^0-9A-Za-z一-鿿]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM pages) SELECT page_id, CASE WHEN s = '' THEN 'video' ELSE s END AS slug FROM s""")
def q46(spark, d):
    return table(spark, d, "pages").select("page_id", slug(F.col("url")).alias("slug"))


@query("q47_digit_parse", """WITH d AS (SELECT conv_id, turn, regexp_replace(text, '[^0-9]', '', 'g') AS g FROM conversations) SELECT conv_id, turn, nullif(g, '') AS digits, CASE WHEN length(g) BETWEEN 1 AND 18 THEN CAST(g AS BIGINT) END AS number FROM d""")
def q47(spark, d):
    g = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", "[^0-9]", "").alias("g"))
    # every digit is kept; a number beyond what a long holds has its digits only
    return g.select("conv_id", "turn", F.nullif("g", F.lit("")).alias("digits"), F.when(F.length("g").between(1, 18), F.col("g").try_cast("long")).alias("number"))


@query("q48_json_extract", """SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY ALL""")
def q48(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


@query("q49_line_fragment_filter", f"""
WITH {OBS}, i AS (SELECT *, lag(t) OVER (PARTITION BY track ORDER BY t, id) AS p FROM obs), g AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p > 10800 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS k FROM i),
f AS (SELECT track, k, count(*) AS n, max(y) - min(y) AS jump, bool_or(kind = 'view') AS anchored FROM g GROUP BY track, k)
SELECT track, CAST(k AS BIGINT) AS island, n FROM f WHERE NOT (n BETWEEN 2 AND 3 AND anchored AND jump > 60)""")
def q49(spark, d):
    g = ordered.gap_islands(observations(spark, d), ["track"], "t", 3 * HOUR, "id")
    f = g.groupBy("track", "island").agg(F.count("*").alias("n"), (F.max("y") - F.min("y")).alias("jump"), F.bool_or(F.col("kind") == "view").alias("anchored"))
    return f.where("NOT (n BETWEEN 2 AND 3 AND anchored AND jump > 60)").select("track", "island", "n")


@query("q50_axis_family_snap", f"""
WITH {OBS}, a AS (SELECT *, y * 1.8 AS deg, CAST(round_even(t / 3600, 0) AS BIGINT) AS frame FROM obs), n AS (SELECT frame, CASE WHEN abs(deg) <= 15 THEN 0 WHEN abs(deg - 90) <= 15 THEN 90 END AS axis, id, deg FROM a),
m AS (SELECT frame, axis, count(*) AS n, median(deg) AS med FROM n WHERE axis IS NOT NULL GROUP BY frame, axis),
s AS (SELECT n.frame, n.axis, median(abs(deg - med)) AS mad FROM n JOIN m ON n.frame = m.frame AND n.axis = m.axis GROUP BY ALL)
SELECT n.id, round(CASE WHEN m.n >= 3 AND s.mad <= 6 THEN n.axis ELSE n.deg END, 3)::DOUBLE AS snapped FROM n LEFT JOIN m ON n.frame = m.frame AND n.axis = m.axis LEFT JOIN s ON n.frame = s.frame AND n.axis = s.axis""")
def q50(spark, d):
    n = observations(spark, d).withColumn("deg", F.col("y") * 1.8).withColumn("frame", F.rint(F.col("t") / 3600).cast("long")).withColumn("axis", F.when(F.abs("deg") <= 15, 0).when(F.abs(F.col("deg") - 90) <= 15, 90)).select("frame", "axis", "id", "deg")
    m = n.where("axis IS NOT NULL").groupBy("frame", "axis").agg(F.count("*").alias("n"), F.expr("percentile(deg, 0.5)").alias("med"))
    s = n.join(m, ["frame", "axis"]).groupBy("frame", "axis", "n").agg(F.expr("percentile(abs(deg - med), 0.5)").alias("mad"))
    return n.join(s, ["frame", "axis"], "left").select("id", r(F.when((F.col("n") >= 3) & (F.col("mad") <= 6), F.col("axis")).otherwise(F.col("deg")).cast("double"), 3).alias("snapped"))


@query("q51_delta_zigzag_encode", """
WITH q AS (SELECT *, CAST(round(l_quantity) AS BIGINT) AS v FROM lineitem), d AS (SELECT *, v - coalesce(lag(v) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice), 0) AS d FROM q)
SELECT l_orderkey, l_linenumber, d, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS z FROM d""")
def q51(spark, d):
    v = F.round("l_quantity").cast("long")
    q = table(spark, d, "lineitem").withColumn("v", v).withColumn("d", F.col("v") - F.coalesce(F.lag("v").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")), F.lit(0)))
    return q.select("l_orderkey", "l_linenumber", "d", zigzag(F.col("d")).alias("z"))


@query("q52_top1_rank_swap", f"""
WITH {OBS}, c AS (SELECT a.track, a.id, b.id AS other, abs(a.y - b.y) AS score, row_number() OVER (PARTITION BY a.track, a.id ORDER BY abs(a.y - b.y), b.id) AS k FROM obs a JOIN obs b ON a.track = b.track AND a.kind = 'view' AND b.kind = 'click' AND abs(b.t - a.t) <= 36000)
SELECT track, id, other, score FROM c WHERE k = 1 AND score <= 15""")
def q52(spark, d):
    o = observations(spark, d).select("track", "id", "t", "y", "kind")
    j = joins.band_join(o.where("kind = 'view'"), o.where("kind = 'click'"), ["track"], "t", -10 * HOUR, 10 * HOUR).withColumn("score", F.abs(F.col("y") - F.col("y_r")))
    return joins.argmin_per(j, ["track", "id"], F.col("score"), "id_r").where("score <= 15").select("track", "id", F.col("id_r").alias("other"), "score")


@query("q53_hough_bincount", f"""
WITH {OBS}, a AS (SELECT unnest(generate_series(0, 89)) AS th), h AS (SELECT th, CAST(round_even(round(x * cos(radians(th * 2)) + y * sin(radians(th * 2)), 6), 0) AS BIGINT) AS rho, count(*) AS n FROM obs, a GROUP BY 1, 2)
SELECT th, rho, n FROM h WHERE n > 65""")
def q53(spark, d):
    a = F.radians(F.col("th") * 2)
    o = observations(spark, d).select("x", "y", F.explode(F.sequence(F.lit(0), F.lit(89))).alias("th"))
    rho = F.rint(F.round(F.col("x") * F.cos(a) + F.col("y") * F.sin(a), 6)).cast("long")
    return o.groupBy(F.col("th").cast("long").alias("th"), rho.alias("rho")).agg(F.count("*").alias("n")).where("n > 65")


@query("q54_tracker_assignment")
def q54(spark, d):
    from .operators.tracking import track_rows

    o = observations(spark, d).select((F.col("track") % 8).alias("video"), F.rint(F.col("t") / 3600).cast("long").alias("frame"), "id", F.col("x").alias("px"), F.col("y").cast("double").alias("py"))
    return track_rows(o)


@query("q55_interval_ilp")
def q55(spark, d):
    from .operators.solve import allocate_table

    return allocate_table(observations(spark, d))


@query("q56_reconcile_local")
def q56(spark, d):
    from .fit_queries import reconciled

    return reconciled(observations(spark, d))


@query("q57_curve_simplify")
def q57(spark, d):
    from .operators.curves import simplify_paths

    return simplify_paths(observations(spark, d).select("track", "t", "id", "x", F.col("y").cast("double").alias("y")), 12.0)


@query("q58_codec_roundtrip", """SELECT l_orderkey, count(*) AS n, true AS equal, round(sum(l_quantity), 2)::DOUBLE AS quantity, round(sum(l_extendedprice), 2)::DOUBLE AS price FROM lineitem GROUP BY l_orderkey""")
def q58(spark, d):
    from .operators.curves import codec_check

    return codec_check(table(spark, d, "lineitem"))


@query("q59_stream_sessions", ORACLES["q02_session_window_counts"])
def q59(spark, d):
    from .streaming.sessions import stream_sessions

    return stream_sessions(spark, f"{d}/events.parquet", "10 hours")
