"""Streams against their batch forms; ordered operators that deal rows out by ranges or islands against loops."""
import statistics

import numpy as np

from obsweave.operators import greedy, paths
from obsweave.operators.tracking import Tracker, nearest_free, track_rows
from obsweave.plans.calibration import median
from obsweave.streaming.tracker import track_stream

SCHEMA = "video long, frame long, id long, px double, py double"


def detections():
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for video in range(3):
        for walk in range(6):
            frame, x, y = int(rng.integers(0, 40)), *rng.uniform(0, 400, 2)
            for _ in range(25):
                frame += int(rng.choice([1, 1, 1, 2, 12], p=[0.6, 0.2, 0.1, 0.07, 0.03]))
                x, y = x + rng.normal(2, 1), y + rng.normal(1, 1)
                rows.append((video, frame, k, float(x), float(y)))
                k += 1
    return rows


def test_track_parts_equal_one_run(spark):
    rows = detections()
    for tracker in (Tracker(), Tracker(greedy=True)):
        want = {}
        for video in range(3):
            want |= {(video, i): n for i, n in tracker.run([r[1:] for r in rows if r[0] == video])}
        got = {(r.video, r.id): r.track_no for r in track_rows(spark.createDataFrame(rows, SCHEMA), tracker).collect()}
        assert got == want
    assert track_rows(spark.createDataFrame([], SCHEMA)).collect() == []


def test_stream_equals_batch(spark, tmp_path):
    rows = detections()
    frames = sorted({r[1] for r in rows})
    for k, low in enumerate(range(0, len(frames), 17)):
        some = set(frames[low : low + 17])
        path = str(tmp_path / f"in-{k}")
        spark.createDataFrame([r for r in rows if r[1] in some], SCHEMA).coalesce(1).write.parquet(path)
    folder = tmp_path / "all"
    folder.mkdir()
    for k in range(len(range(0, len(frames), 17))):
        part = next((tmp_path / f"in-{k}").glob("*.parquet"))
        part.rename(folder / f"{k:03}.parquet")
        import os

        os.utime(folder / f"{k:03}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = track_stream(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.video, r.id): r.track_no for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.video, r.id): r.track_no for r in track_rows(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want and len(got) == len(rows)
    assert len(q.recentProgress) >= 3 and sum(p.numInputRows for p in q.recentProgress) == len(rows)


def test_nearest_free():
    cost = np.array([[1.0, 2.0, 1e6], [1.5, 0.5, 1e6]])
    assert nearest_free(cost) == [(0, 0), (1, 1)]


def test_median(spark):
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 1000):
        v = [float(x) for x in rng.integers(0, 50, n)]
        got = median(spark.createDataFrame([(x,) for x in [*v, None]], "x double"), "x").collect()
        assert len(got) == 1 and got[0].median == (statistics.median(v) if v else None)


def test_numbered(spark):
    rows = [(k * 7919 % 1000, k % 3) for k in range(1000)]
    got = {(r.a, r.b): r.place for r in paths.numbered(spark.createDataFrame(rows, "a long, b long"), ["a", "b"]).collect()}
    assert got == {r: k + 1 for k, r in enumerate(sorted(rows))}


def test_slots_by_island(spark):
    rng = np.random.default_rng(9)
    rows = sorted((float(s), float(s + d), k) for k, (s, d) in enumerate(zip(rng.uniform(0, 300, 200), rng.uniform(0, 6, 200))))
    ends, want = [], {}
    for s, e, k in rows:
        at = next((i for i, x in enumerate(ends) if x + 0.001 < s), len(ends))
        ends[at : at + 1] = [e]
        want[k] = at
    df = spark.createDataFrame([(1, *r) for r in rows], "track long, t double, e double, id long")
    assert {r.id: r.slot for r in greedy.slots(df, ["track"], "t", "e", "id", 0.001).collect()} == want
