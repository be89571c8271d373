"""Joins on time and place whose rows come in another order each time they are read."""
import statistics

import duckdb
import pytest

from obsweave.operators import holds, joins, motion, ordered
from obsweave.plans.paths import overlap_distance
from obsweave.registry import ORACLES, QUERIES
from obsweave.sources.tables import observations

SF = "/root/testdata/sf0.01"


def restless(df):
    """The same rows; a task gives them in another order each time."""

    def run(parts):
        for p in parts:
            yield p.sample(frac=1)

    return df.coalesce(1).mapInPandas(run, df.schema)


def test_tolerant_anti_on_restless_rows(spark):
    a = [(k % 7, k * 37 % 211, k * 53 % 97) for k in range(600)]
    b = [(k % 7, k * 41 % 211, k * 59 % 97) for k in range(60)]
    left = spark.createDataFrame([*a, *a[:9], (None, 1, 1), (1, None, 1)], "frame long, px long, py long")
    right = spark.createDataFrame([*b, (None, 1, 1)], "frame long, px long, py long")
    want = [x for x in [*a, *a[:9]] if not any(x[0] == y[0] and abs(x[1] - y[1]) <= 4 and abs(x[2] - y[2]) <= 4 for y in b)] + [(None, 1, 1), (1, None, 1)]
    got = joins.tolerant_anti(restless(left), right, ["frame"], ["px", "py"], 4).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and 0 < len(want) < 600


def test_interpolate_looks_back_only(spark):
    """A frame without an end is gone through anew for each row."""
    points = spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, 10.0), (1, 3.0, 0.0), (2, 5.0, 7.0), (2, None, 1.0)], "track long, t double, x double")
    at = spark.createDataFrame([(k, t) for k in (1, 2, 3) for t in (-1.0, 0.0, 0.5, 1.0, 2.0, 3.0, 9.0)], "track long, t double")
    got = ordered.interpolate(points, at)
    assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {1: [0.0, 0.0, 5.0, 10.0, 5.0, 0.0, 0.0], 2: [7.0] * 7, 3: [None] * 7}
    assert [x.interpolated for x in sorted(got.collect())] == sum(want.values(), [])
    ahead = joins.as_of(at, points, ["track"], "t", ["x"], forward=True)
    assert "unboundedfollowing" not in ahead._jdf.queryExecution().optimizedPlan().toString()
    assert [x.x_r for x in sorted(ahead.collect()) if x.track == 1] == [0.0, 0.0, 10.0, 10.0, 0.0, 0.0, None]


def test_span_index_keeps_rows_that_are_there_twice(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT * FROM '{SF}/events.parquet' UNION ALL SELECT * FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet'")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.sql(ORACLES["q71_span_index"])
    got = QUERIES["q71_span_index"](spark, str(tmp_path)).select(*want.columns)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want.fetchall()) and len(rows) > len(set(rows))


def awkward_events(path):
    """Missing users, times and values, numbers that are none or endless, rows and times that are there twice, a long track and short ones, and tracks apart in time; and the rows of q23's SQL."""
    value = "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 31 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 97 = 0 THEN 'Infinity'::DOUBLE WHEN event_id % 13 = 0 THEN -value ELSE value END"
    user = "CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 3 WHEN event_id % 29 = 0 THEN -event_id ELSE user_id END"
    ts = "CASE WHEN event_id % 47 = 0 THEN NULL WHEN event_id % 11 = 0 THEN date_trunc('day', ts) ELSE ts END + CASE WHEN user_id % 4 = 0 THEN INTERVAL 100 DAY ELSE INTERVAL 0 DAY END"
    rows = f"SELECT event_id, {ts} AS ts, {user} AS user_id, event_type, {value} AS value, props FROM '{SF}/events.parquet'"
    duckdb.sql(f"COPY ({rows} UNION ALL SELECT * FROM ({rows}) WHERE event_id % 5 = 0) TO '{path}/events.parquet'")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
    return con.sql(ORACLES["q23_overlap_resample"])


def test_overlaps_of_awkward_events(spark, tmp_path):
    """A missing value leaves the median and the largest distance to the others; a cell of values that are no numbers is a cell."""
    want = awkward_events(tmp_path)
    got = QUERIES["q23_overlap_resample"](spark, str(tmp_path)).select(*want.columns).collect()
    rows = want.fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows)) and len(rows) > 300
    assert {str(x[2]) for x in rows} > {"nan", "None"}


@pytest.mark.parametrize("most, step", [(700, 8), (3000, 64), (10**6, 10**6)])
def test_overlaps_in_blocks_of_any_size(spark, tmp_path, most, step):
    """Pairs are found and measured where two blocks meet: no row a shared cell, pair or time goes through an exchange."""
    want = awkward_events(tmp_path)
    found = overlap_distance(observations(spark, str(tmp_path)), {"t": 3600.0, "x": 10.0}, 2, 86400.0, 5, most, step)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = [(x.a, x.b, x.med is None) for x in found.collect()]
    assert sorted(got) == sorted((a, b, med is None) for a, b, med, _ in want.fetchall())


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_overlaps_have_a_partition_a_block(spark, adaptive):
    """Blocks meet in a task a pair of them, whatever the number of shuffle partitions."""
    rows = spark.createDataFrame([(k, t * 50000.0, float(k % 3)) for k in range(40) for t in range(5)], "track long, t double, x double")
    was = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", 50)
        found = overlap_distance(rows, {"t": 3600.0, "x": 10.0}, 2, 86400.0, 5, 25)
        assert found.rdd.getNumPartitions() == 8 * 8 and found.count() == 40 * 39 // 2
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)


def test_overlaps_of_nothing(spark):
    none = spark.createDataFrame([(1, None, 1.0), (None, 5.0, 1.0), (2, 7.0, None)], "track long, t double, x double")
    assert overlap_distance(none, {"t": 3600.0, "x": 10.0}, 2, 0.0, 5).collect() == []


@pytest.mark.parametrize("block", [4, 1000])
def test_unrepresented_meets_partners_until_one_is_found(spark, block):
    """Tracks that others represent leave the rounds; those without a partner meet all, in any block size."""
    rows = [(kind, t, f, t * t * 7 % 60 + f * (t % 3) if (t + f) % 11 else None) for kind in ("a", "b") for t in range(24) for f in range(t % 7, 9)] + [("a", None, 1, 1), ("a", 99, None, 1)]
    path = {}
    for kind, t, f, y in rows:
        path.setdefault((kind, t), {})[f] = y

    def stands_for(p, q):
        both = [f for f in p if f in q and f is not None]
        gap = [abs(p[f] - q[f]) for f in both if p[f] is not None and q[f] is not None]
        return len(both) >= 4 and gap and statistics.median(gap) < 18 and sum(g < 30 for g in gap) / len(both) >= 0.7

    want = {k for k, p in path.items() if k[1] is None or not any(stands_for(p, q) for m, q in path.items() if m[0] == k[0] and m[1] not in (None, k[1]))}
    got = motion.unrepresented(spark.createDataFrame(rows, "kind string, track long, frame long, y int"), 4, 18, 30, 0.7, block).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want) and 3 < len(want) < len(path) - 3


def test_sprites_meet_their_points_once(spark):
    e = spark.createDataFrame([(1, 1, True, 1, 0, "high")], "video long, event long, fake boolean, type int, frames int, confidence string")
    p = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0)], "video long, event long, t double, x double, y double")
    assert holds.same_sprites(e, p)._jdf.queryExecution().optimizedPlan().toString().count("Window") <= 3
