"""A conversion from detections to a script, resumed, repeated with other options, and its second pass."""
import pytest

from obsweave.plans import convert
from obsweave.plans.runs import Run
from obsweave.sources import script

DETECTION = "video long, frame long, id long, px double, py double, kind string"
READING = "video long, t double, count int, error double, margin double"


def falling(first, x, kind="tap", count=24):
    return [(1, first + k, x, 20.0 + 13 * k, kind) for k in range(count)]


@pytest.fixture
def tables(spark):
    walks = falling(0, 100.0) + falling(30, 300.0) + falling(33, 500.0) + falling(60, 200.0, "hold", 40) + falling(100, 400.0, "tap", 3) + [(v, f, x + 3, y, k) for v, f, x, y, k in falling(30, 300.0)]
    rows = [(v, f, i, x, y, k) for i, (v, f, x, y, k) in enumerate(sorted(walks))]
    hits = [21 / 30, 51 / 30, 54 / 30, 81 / 30, 99 / 30]  # the last is the release of the hold
    readings, n = [], 0
    for f in range(140):
        t = round((f + 0.5) / 30, 4)
        n = sum(h < t for h in hits)
        readings.append((1, t, n, 0.01 if f % 7 else 0.3, 0.1))
    readings.append((1, 0.31, 9, 0.5, 0.0))  # an unreliable one
    return spark.createDataFrame(rows, DETECTION), spark.createDataFrame(readings, READING)


def test_passes_resume_and_export(spark, tmp_path, tables):
    source, readings = tables
    run = Run(spark, str(tmp_path / "run"), source, "v1")
    events = {(r.kind, round(r.x)): r for r in convert.first_pass(run, readings, "r1").collect()}
    real = {k for k, r in events.items() if not r.fake}
    assert real in ({("tap", 100), ("tap", 300), ("tap", 500), ("hold", 200)}, {("tap", 100), ("tap", 303), ("tap", 500), ("hold", 200)})  # the sprite that was there twice counts once
    assert all(abs(r.time - r.seen) <= 0.09 for r in events.values()) and events["hold", 200].duration > 0.4
    convert.export(run, "events", 1, "One", str(tmp_path / "s1"))
    text = b"".join(script.script_bytes(spark, str(tmp_path / "s1"))).decode().splitlines()
    assert text[1] == "title One" and sum(x.startswith("note ") for x in text) == len(events) and sum(x.endswith(" real") for x in text) == 4
    # the same again: nothing is made anew; another title: the script alone
    again = Run(spark, str(tmp_path / "run"), source, "v1")
    convert.first_pass(again, readings, "r1")
    convert.export(again, "events", 1, "Two", str(tmp_path / "s2"))
    assert [d["stage"] for d in again.done if not d["reused"]] == ["script-1"]
    # other readings: what depends on them
    other = Run(spark, str(tmp_path / "run"), source, "v1")
    convert.first_pass(other, readings.where("t < 2.2"), "r2")
    assert [d["stage"] for d in other.done if d["reused"]] == ["points", "notes", "single"]
    # the second pass takes the first one's tables
    second = Run(spark, str(tmp_path / "run"), source, "v1")
    convert.first_pass(second, readings, "r1")
    last = convert.second_pass(second)
    assert {(r.kind, round(r.x)) for r in last.where("NOT fake").collect()} == real and [d["stage"] for d in second.done if not d["reused"]] == ["pins", "fit-2", "events-2"]
