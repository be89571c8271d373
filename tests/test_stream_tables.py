"""Streams that append: sessions, landing files, timed state and progress, each stopped and started again."""
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsweave.operators.tracking import Tracker, track_rows
from obsweave.plans.progress import Phases, by_phase, passing
from obsweave.streaming.landing import Landing
from obsweave.streaming.sessions import SessionStream, sessions
from obsweave.streaming.tracker import track_stream

EVENT = "user_id long, ts timestamp_ntz"


def drop_file(spark, rows, schema, folder, k):
    """One more file in the folder, newer than the ones before."""
    part = folder.parent / f"part-{folder.name}-{k}"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(part))
    to = folder / f"{k:03}.parquet"
    next(part.glob("*.parquet")).rename(to)
    os.utime(to, (1_700_000_000 + k, 1_700_000_000 + k))


def at(minute):
    return np.datetime64("2024-01-01") .astype("datetime64[us]").astype(object) + np.timedelta64(int(minute * 60), "s").astype("timedelta64[us]").astype(object)


@pytest.fixture
def events(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rng = np.random.default_rng(4)
    rows = sorted((float(m), int(u)) for m, u in zip(rng.uniform(0, 3000, 300), rng.integers(0, 6, 300)))
    for k in range(5):
        drop_file(spark, [(u, at(m)) for m, u in rows[k * 60 : k * 60 + 60]], EVENT, folder, k)
    return folder, rows


def stream_of(spark, folder, schema=EVENT):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_sessions_append_once_though_killed(spark, events, tmp_path):
    folder, rows = events
    root = f"file://{tmp_path}/sessions"
    want = sorted(tuple(r) for r in sessions(spark.createDataFrame([(u, at(m)) for m, u in rows], EVENT), "30 minutes").collect())

    class Killed(SessionStream):
        def each(self, batch, k):
            super().each(batch, k)
            if k == 2:
                raise RuntimeError("killed after writing, before the batch was committed")

    with pytest.raises(Exception, match="killed"):
        Killed(spark, root, "30 minutes", "1 hour").run(stream_of(spark, folder))
    s = SessionStream(spark, root, "30 minutes", "1 hour")
    s.run(stream_of(spark, folder))
    assert sorted(tuple(r) for r in s.all().collect()) == want
    closed = sorted(tuple(r)[:3] for r in s.closed.rows().collect())
    assert len(closed) == len(set(closed)) and 0 < len(closed) < len(want) and set(closed) <= set(want)
    assert s.open.rows().select("batch").distinct().count() <= 2 and s.late.rows().isEmpty()
    # rows that come too late go to a table of their own and change no session
    drop_file(spark, [(1, at(10.5)), (2, at(3001.0))], EVENT, folder, 5)
    s.run(stream_of(spark, folder))
    assert [tuple(r) for r in s.late.rows().collect()] == [(1, at(10.5), 5)]
    assert set(closed) <= {tuple(r)[:3] for r in s.closed.rows().collect()} and s.all().agg(F.sum("n")).first()[0] == 301


def test_landing_takes_each_file_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put = lambda name, n: (folder / name).write_bytes(b"x" * n)
    put("a.raw", 10), put("b.raw", 0), put("c.txt", 5), put("d.raw", 7)
    tickets = spark.createDataFrame([("d.raw", 0.1, 150, "low"), ("a.raw", 0.5, 100, " A title ")], "name string, judge_y double, threshold int, title string")
    root = f"file://{tmp_path}/out"

    class Killed(Landing):
        def each(self, files, k):
            super().each(files, k)
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        Killed(spark, str(folder), root, tickets).run()
    land = Landing(spark, str(folder), root, tickets)
    land.run()
    put("e.raw", 3), put("f.RAW", 4), put("g.raw", 0)
    land.run()
    Landing(spark, str(folder), root, tickets).run()  # nothing new
    good = sorted((r.name, r.length, r.judge_y, r.threshold, r.title) for r in land.accepted.rows().collect())
    assert good == [("a.raw", 10, 0.5, 100, "A title"), ("e.raw", 3, 0.82361, 168, "Video reconstruction"), ("f.RAW", 4, 0.82361, 168, "Video reconstruction")]
    assert sorted((r.name, r.reason) for r in land.rejected.rows().collect()) == [("b.raw", "size"), ("c.txt", "kind"), ("d.raw", "parameters"), ("g.raw", "size")]


DETECTION = "video long, frame long, id long, px double, py double"


def test_sizes_of_uploads(spark, tmp_path):
    files = spark.createDataFrame([(f"file:/x/{n}.raw", None, n) for n in (0, 1, 2 << 30, (2 << 30) + 1)], "path string, modificationTime timestamp, length long")
    assert {r.length: r.reason for r in Landing(spark, str(tmp_path), str(tmp_path)).checked(files).collect()} == {0: "size", 1: None, 2 << 30: None, (2 << 30) + 1: "size"}


def test_tracker_state_goes_and_comes_back(spark, tmp_path):
    folder, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    folder.mkdir()
    tracker = Tracker(keep=6)
    rng = np.random.default_rng(3)
    rows = []
    for video, frames in ((1, range(0, 30)), (2, range(0, 200)), (1, range(150, 170))):
        for f in frames:
            rows += [(video, f, 1000 * video + 10 * f + j, 50.0 * j + 2 * f + float(rng.normal(0, 1)), 80.0 * j) for j in range(3)]

    def run():
        q = track_stream(stream_of(spark, folder, DETECTION), tracker).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start()
        q.awaitTermination()

    def state(name):
        return spark.read.format("statestore").option("stateVarName", name).load(progress)

    cuts = [0, 20, 40, 60, 100, 140]
    files = [[r for r in rows if a <= r[1] < b] for a, b in zip(cuts, [*cuts[1:], 1000])]
    for k in range(4):
        drop_file(spark, files[k], DETECTION, folder, k)
    run()
    assert {r.key.video for r in state("tracks").select("key").distinct().collect()} == {2}  # video 1 has been silent for longer than `keep` frames
    assert {r.key.video for r in state("number").select("key").distinct().collect()} == {1, 2}
    for k in (4, 5):
        drop_file(spark, files[k], DETECTION, folder, k)
    run()  # started again from the checkpoint; video 1 goes on with its numbers
    got = {(r.video, r.id): r.track_no for r in spark.read.parquet(out).collect()}
    want = {(r.video, r.id): r.track_no for r in track_rows(spark.createDataFrame(rows, DETECTION), tracker).collect()}
    assert got == want


def test_progress_of_a_stream(spark, events, tmp_path):
    folder, rows = events
    phases = Phases(spark, "r1")
    spark.streams.addListener(phases)
    try:
        s = passing(stream_of(spark, folder), "read", users=F.max("user_id"))
        s = passing(s.where("user_id < 3"), "some")
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start()
        q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        import time

        for _ in range(50):  # the listener hears of batches a little later
            if phases.table().count() >= 10:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(phases)
    phases.save(str(tmp_path / "progress"))
    got = {r.phase: (r.rows, r.batches) for r in by_phase(spark.read.parquet(str(tmp_path / "progress"))).collect()}
    assert got == {"read": (300, 5), "some": (sum(u < 3 for _, u in rows), 5)} and phases.table().isEmpty()
