"""Total orders and medians over many ranges: the same whether small ranges are joined to one or not."""
import statistics

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from obsweave.operators import events, paths
from obsweave.plans.calibration import median
from obsweave.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(params=["true", "false"])
def ranges(spark, request):
    """All ranges apart, or joined as Spark sees fit."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, request.param)
    yield
    spark.conf.unset(name)


@pytest.mark.parametrize("q", ["q03_tumbling_calibration", "q110_total_order", "q113_batch_report", "q138_best_first"])
def test_queries_over_ranges(spark, ranges, q):
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[q])
    names = want.columns
    got = sorted(tuple(r[c] for c in names) for r in QUERIES[q](spark, SF).collect())
    assert got == sorted(want.fetchall())


def test_numbered(spark, ranges):
    rows = [(k * 7919 % 5000, k % 3, "x" * (k % 50)) for k in range(5000)]
    df = paths.numbered(spark.createDataFrame(rows, "a long, b long, c string").repartition(8), ["a", "b"])
    assert df.schema["place"].dataType.typeName() == "long"
    assert {(r.a, r.b): r.place for r in df.select("a", "b", "place").collect()} == {r[:2]: k + 1 for k, r in enumerate(sorted(rows))}
    assert df.agg(F.countDistinct("place"), F.max("place")).first()[:] == (5000, 5000)  # fewer columns are read: the same places


def test_median(spark, ranges):
    v = [float(x) for x in np.random.default_rng(2).normal(0, 9, 4001)]
    assert median(spark.createDataFrame([(x,) for x in [*v, None]], "x double").repartition(8), "x").first().median == statistics.median(v)


def test_nudged(spark, ranges):
    rows = [(k, float((k * 7919) % 4000), 0.0, 1, False, None, 0.0, 0.0, k % 5 > 0) for k in range(4000)]
    e = spark.createDataFrame(rows, "event_id long, time double, duration double, type int, is_fake boolean, contact double, ring double, head double, shown boolean").repartition(8)
    shown = [r[0] for r in sorted(rows, key=lambda r: r[1]) if r[8]]
    bad = [5, 700, 3100]
    got = events.nudged(e, spark.createDataFrame([(p, -1.0) for p in bad], "place int, judged double")).where("moved").select("event_id").collect()
    assert sorted(r.event_id for r in got) == sorted(shown[p] for p in bad)
