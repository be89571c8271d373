"""Operators on events with paths, on small literal cases."""
import numpy as np
from pyspark.sql import functions as F

from obsweave.operators import events as ev
from obsweave.operators import paths
from obsweave.functions.scalar import fallback_lead

NAMES = [c.split()[0] for c in ev.EVENT.split(", ")]


def sprite(k, fake=True, y=100, count=12, kind=0):
    p = [[i / 30, 500.0 - i * 20, float(y + i * 20)] for i in range(count)]
    return dict(zip(NAMES, (k, p[-1][0], 0.0, kind, fake, count, "medium", k, 960.0, None, 0.0, 0.0, p, None)))


def hold(k, at, lasting, head, ring, offset=0.0, contact=1.0):
    line = lambda o: [[t, 300 + 25 * t + o, 200 + 40 * t] for t in np.linspace(0.70, 1.37, 10).tolist()]
    return dict(zip(NAMES, (k, at, lasting, 0, False, 10, "medium", 42, 1260.0, contact, ring, head, line(offset), line(offset - 80))))


def left(spark, rows, find):
    df = spark.createDataFrame([(1, *(r[n] for n in NAMES)) for r in rows], f"video long, {ev.EVENT}")
    return {r.event_id for r in ev.deduplicated(df, find).collect()}


def test_endpoint_duplicates(spark):
    first = hold(1, 1.0, 0.40, 0.85, 0.90)
    assert left(spark, [first, hold(2, 1.12, 0.28, 0.30, 0.70, 2.0)], ev.endpoint_duplicates) == {1}
    assert left(spark, [first, hold(2, 1.12, 0.28, 0.30, 0.70, 2.0, contact=1.12)], ev.endpoint_duplicates) == {1, 2}
    assert left(spark, [first, hold(2, 1.12, 0.28, 0.30, 0.70, 40.0)], ev.endpoint_duplicates) == {1, 2}


def test_pinned(spark):
    rows = [(1.0, 1.06, 0.95, 0.9, False, False), (2.0, 2.06, 0.95, 0.9, False, True), (3.0, 3.06, 0.95, 0.9, True, False), (4.0, 4.06, 0.4, 0.9, False, False), (5.0, 5.2, 0.95, 0.9, False, False), (6.0, None, 0.95, 0.9, False, False)]
    df = spark.createDataFrame(rows, "t double, c double, r double, h double, f boolean, a boolean")
    assert [x.p for x in df.select(ev.pinned(*(F.col(c) for c in "tcrhfa")).alias("p")).collect()] == [True] + [False] * 5


def test_nudged(spark):
    schema = "event_id long, time double, duration double, type int, is_fake boolean, contact double, ring double, head double, shown boolean"
    rows = [(7, 1.0, 0.4, 0, False, None, 0.5, 0.5, True), (8, 2.0, 0.0, 0, False, 2.0, 0.95, 0.95, True), (9, 0.5, 0.0, 0, True, None, 0.0, 0.0, False)]
    got = {r.event_id: (r.time, r.duration, r.moved) for r in ev.nudged(spark.createDataFrame(rows, schema), spark.createDataFrame([(0, 0.9), (1, 1.9), (5, 0.0)], "place int, judged double")).collect()}
    assert got == {7: (round(1 + 1 / 30, 5), round(1.4 - round(1 + 1 / 30, 5), 5), True), 8: (2.0, 0.0, False), 9: (0.5, 0.0, False)}


def test_teleporting_rails(spark):
    s = "kind string, samples array<struct<time:double,x:double,y:double,nativeAnchor:boolean,anchored:boolean>>"
    rows = [("rail", [(110.56665, 2058.9, 2773.2, True, False), (110.59998, -480.0, -360.0, True, True)]), ("rail", [(1.0, -20.0, 50.0, True, True), (1.033, -18.0, 52.0, True, True)]), ("rail", []), ("ring", [(1.0, 0.0, 0.0, True, False), (1.01, 5000.0, 0.0, True, True)])]
    assert [r.x for r in spark.createDataFrame(rows, s).select(ev.teleports(F.col("kind")).alias("x")).collect()] == [True, False, False, False]


def test_approach(spark):
    p = "array<struct<t:double,x:double,y:double>>"
    rows = [([(0.98, 640.0, 560.0), (0.99, 640.0, 590.0), (1.0, 640.0, 620.0)],), ([(0.50, 640.0, 180.0), (0.5333, 640.0, 212.0), (0.5667, 640.0, 244.0), (0.60, 640.0, 276.0), (0.6333, 640.0, 308.0)],)]
    got = [r.start for r in paths.extended(spark.createDataFrame(rows, f"p {p}"), "p", F.lit(1.0), 0.01, 0.08, 0.12, 300.0, 680.0, 28.0, 0.75).collect()]
    assert got[0].t == 0.98 and got[1].t < 0.5 and got[1].y <= 1
    lead = [r.x for r in spark.createDataFrame([(True, False), (False, False), (True, True)], "i boolean, f boolean").select(fallback_lead(F.col("i"), F.col("f")).alias("x")).collect()]
    assert lead == [0.02, 0.6, 0.6]


def test_consolidated():
    line = lambda k, a, b: dict(sprite(k), time=a, duration=b - a, path=[[t, 100.0, 200 * t] for t in np.linspace(a, b, 12).tolist()])
    out = ev.consolidated([line(1, 1.0, 2.0), line(2, 1.5, 2.6), line(3, 2.2, 3.0), dict(line(4, 1.0, 2.0), path=[[1.0, 500.0, 0.0], [2.0, 500.0, 9.0]])])
    assert [(e["event_id"], round(e["time"] + e["duration"], 6)) for e in out] == [(1, 3.0), (4, 2.0)]
    assert out[0]["path"][0][0] == 1.0 and out[0]["path"][-1][0] == 3.0 and all(x[0] < y[0] for x, y in zip(out[0]["path"], out[0]["path"][1:]))


def test_tail_contact():
    path = [[1.0 + k / 30, 0.0, 300.0 + k * 40] for k in range(9)]  # 1,200 pixels a second down
    assert abs(ev.tail_contact(path, 1.02, 592.0) - (1.0 + 292 / 1200)) < 1e-9  # measured
    assert abs(ev.tail_contact(path[:5], 1.02, 592.0) - (1.0 + 292 / 1200)) < 1e-9 and ev.tail_contact(path[:5], 1.02, 592.0) > 1.22  # carried on
    assert ev.tail_contact(path[:3], 1.02, 592.0) is None and ev.tail_contact(path, 1.2, 592.0) is None and ev.tail_contact([], 1.0, 592.0) is None


def test_transitions(spark):
    s = "track long, t double, count int, error double, margin double"
    rows = [(1, 1.0, 5, 0.01, 0.1), (1, 1.1, 5, 0.01, 0.1), (1, 1.15, 9, 0.09, 0.1), (1, 1.2, 6, 0.01, 0.1), (2, 1.0, 3, 0.01, 0.1), (2, 2.0, 3, 0.2, 0.1), (3, 3.0, 1, 0.044, 0.021), (3, 3.5, 2, 0.01, 0.1)]
    got = sorted((r.track, r.before, r.after, round(r.tolerance, 6), r.rise) for r in ev.transitions(spark.createDataFrame(rows, s), ["track"]).collect())
    assert got == [(1, 1.1, 1.2, 0.08, 1), (3, 3.0, 3.5, 0.16, 1)]


def test_same_time(spark):
    import pytest

    from obsweave.operators.joins import same_time

    renders = spark.createDataFrame([(1, 90.53331996, "a"), (1, 90.566, "b")], "k long, t double, name string")
    ask = lambda t: [(r.name_r, round(r.t_r, 8)) for r in same_time(spark.createDataFrame([(1, t)], "k long, t double"), renders, ["k"], "t", ["name"], 1e-6).collect()]
    assert ask(90.53331996) == ask(90.533319961) == ask(90.533319959) == [("a", 90.53331996)]
    with pytest.raises(Exception, match="no row within"):
        ask(90.5)
