"""Queries on fits of events to counters, with the DuckDB SQL that gives the same rows where SQL can."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators.budgets import budgeted
from .plans import joint_fit, reconciliation
from .queries import DAY, HOUR, OBS, query, r
from .sources.shared import held
from .sources.tables import observations


def counter(o, width: float = DAY):
    """track, interval, end, expected: how many views and purchases a counter shows for each interval of `width` from the track's first to its last row."""
    i = F.floor(F.col("t") / width) - F.min(F.floor(F.col("t") / width)).over(Window.partitionBy("track"))
    own = o.withColumn("interval", i)
    span = own.groupBy("track").agg(F.max("interval").alias("last"), F.min(F.floor(F.col("t") / width)).alias("base")).select("track", "base", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("interval"))
    n = own.where("kind IN ('view', 'purchase')").groupBy("track", "interval").agg(F.count("*").alias("n"))
    return span.join(n, ["track", "interval"], "left").select("track", "interval", ((F.col("base") + F.col("interval") + 1) * width).alias("end"), F.coalesce("n", F.lit(0)).alias("expected"))


@query("q143_joint_fit")
def q143(spark, d):
    o = observations(spark, d)
    lasting = F.when(F.col("y") % 5 == 0, 9 * HOUR).otherwise(0.0)
    contact = F.when(F.col("y") % 3 == 0, F.col("t") - 900.0)
    events = o.where("kind <> 'signup'").select("track", F.col("id").alias("event"), F.col("t").alias("time"), lasting.alias("duration"), (F.col("x") / 10).alias("quality"), F.when(F.col("kind") == "purchase", F.col("t")).alias("pin"), contact.alias("contact"), (F.col("y") >= 60).alias("held"))
    grid = counter(o)
    options = joint_fit.fit_options(events, grid, HOUR, 2.5 * HOUR, 36.0, 1800.0, DAY)
    chosen, costs = joint_fit.fit(options, grid)
    rows = joint_fit.cumulative(chosen, grid).join(costs, "track")
    return rows.select("track", "interval", "expected", "got", "carried", "strict", r("cost", 3).alias("cost"))


def reconciled(o, unit: float = 4 * HOUR):
    """track, before, after, moved, exchanged, other: clicks, views and purchases are accepted at first; the counter has clicks, views and errors, a little before or after. Times in units of four hours."""
    base = F.min("t").over(Window.partitionBy("track"))
    t = ((F.col("t") - base) / unit + 0.2).alias("time")
    zero, no, none = F.lit(0.0), F.lit(False), F.lit(None).cast("double")
    lasting = F.when(F.col("y") % 6 == 0, 0.1).otherwise(0.0)
    e = o.select("track", F.col("id").alias("event"), F.round(t, 6).alias("time"), lasting.alias("duration"), F.col("kind").isin("error", "signup").alias("fake"), no.alias("visual"), (F.col("x") / 100).alias("ring"), (F.col("y") / 100).alias("head"), zero.alias("hit"), F.col("x").alias("frames"), (F.col("y") % 12).alias("path_size"), (F.col("y") % 2 == 0).alias("target"), none.cast("long").alias("path"), F.col("x"), (F.col("y") % 3 == 0).alias("weak_kind"), (F.col("kind") == "signup").alias("never"), no.alias("wide_kind"), no.alias("capsule"), no.alias("ended"), no.alias("required"), none.alias("pin"), F.when(F.col("x") > 40, F.round(t, 6)).alias("contact"), none.alias("low_edge"), none.alias("high_edge"), none.alias("tail_at"))
    shown = o.select("track", "kind", "y", t).where("kind IN ('click', 'view', 'error')").withColumn("interval", F.floor((F.col("time") + (F.col("y") - 50) / 1000) * 2))
    counts = shown.groupBy("track", "interval").agg(F.count("*").alias("n"))
    grid = e.groupBy("track").agg(F.floor(F.max("time") * 2 + 1).alias("last")).select("track", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("interval"))
    grid = grid.join(counts, ["track", "interval"], "left").select("track", "interval", (F.col("interval") / 2).alias("start"), ((F.col("interval") + 1) / 2).alias("end"), F.coalesce("n", F.lit(0)).alias("expected"))
    done, off = reconciliation.reconcile(reconciliation.measured(e), grid)
    error = off.groupBy("track").agg(F.sum(F.abs("before")).alias("before"), F.sum(F.abs("off")).alias("after"))
    log = done.groupBy("track").agg(F.count_if(F.col("actions").contains("move")).alias("moved"), F.count_if(F.col("actions").contains("exchange")).alias("exchanged"), F.count_if(~F.col("fake")).alias("real"))
    return error.join(log, "track").select("track", "before", "after", "moved", "exchanged", "real")


@query("q144_budgeted_repairs", f"""
WITH {OBS}, b AS (SELECT track, CAST(floor(t / 86400) AS BIGINT) AS slot, count(*) AS budget FROM obs WHERE kind = 'purchase' GROUP BY 1, 2),
o AS (SELECT o.track, b.slot, o.id, least(greatest(o.t, b.slot * 86400 + 60), (b.slot + 1) * 86400 - 60) AS m, o.x, CAST(o.y AS DOUBLE) AS y, -round(o.x / 20 + o.y / 50.0, 6) AS rk, b.budget
      FROM obs o JOIN b ON o.track = b.track AND o.t > b.slot * 86400 - 7200 AND o.t <= (b.slot + 1) * 86400 + 7200 WHERE o.kind IN ('error', 'signup', 'click')),
l AS (SELECT track, list([{{'slot': slot, 'id': id, 'm': m, 'x': x, 'y': y, 'budget': budget}}] ORDER BY slot, rk, id) AS offers FROM o GROUP BY track),
f AS (SELECT track, unnest(list_reduce(offers, lambda a, c: CASE WHEN len(list_filter(a, lambda z: z.slot = c[1].slot)) < c[1].budget AND len(list_filter(a, lambda z: z.id = c[1].id OR (abs(z.m - c[1].m) < 10800 AND (z.x - c[1].x) * (z.x - c[1].x) + (z.y - c[1].y) * (z.y - c[1].y) < 784))) = 0 THEN list_concat(a, c) ELSE a END)) AS e FROM l)
SELECT track, e.slot AS slot, e.id AS id, e.m AS moment FROM f""")
def q144(spark, d):
    o = observations(spark, d)
    b = o.where("kind = 'purchase'").groupBy("track", F.floor(F.col("t") / DAY).alias("slot")).agg(F.count("*").alias("budget"))
    near = o.where("kind IN ('error', 'signup', 'click')").withColumn("slot", F.explode(F.sequence(F.ceil((F.col("t") - 2 * HOUR) / DAY) - 1, F.ceil((F.col("t") + 2 * HOUR) / DAY) - 1)))
    at = F.least(F.greatest(F.col("t"), F.col("slot") * DAY + 60), (F.col("slot") + 1) * DAY - 60)
    offers = near.select("track", "slot", "id", at.alias("moment"), "x", F.col("y").cast("double").alias("y"), (-F.round(F.col("x") / 20 + F.col("y") / 50.0, 6)).alias("rank"))
    return budgeted(offers, b, "track", "slot", "id", ["rank"], "moment", ["x", "y"], 3 * HOUR, 28.0).select("track", "slot", "id", "moment")
