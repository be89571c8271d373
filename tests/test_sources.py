"""Frame sources, packages and runs."""
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsweave.operators import parts
from obsweave.plans.runs import Run, batch_report
from obsweave.sources import frames, package, tables


def test_raw_frames(spark, tmp_path):
    rng = np.random.default_rng(3)
    video = rng.integers(0, 256, (7, 6, 8, 3), dtype=np.uint8)
    (tmp_path / "a.rgb").write_bytes(video.tobytes() + b"cut")
    (tmp_path / "b.rgb").write_bytes(video[:2].tobytes())
    got = {(r.video, r.frame): r for r in frames.read_frames(spark, str(tmp_path), 8, 6, frames_per_task=3).collect()}
    assert sorted(got) == [(0, k) for k in range(7)] + [(1, 0), (1, 1)]
    assert all(got[0, k].pixels == video[k].tobytes() and got[0, k].time == k / 30 for k in range(7))
    one = frames.read_frames(spark, str(tmp_path / "a.rgb"), 8, 6, first=2, last=4, fps=15, crop="1,2,3,4", gray="true").collect()
    assert [r.frame for r in sorted(one)] == [2, 3, 4] and (one[0].height, one[0].width) == (4, 3)
    k = sorted(one)[0]
    assert k.pixels[:1] == bytes([int(video[2, 2, 1].mean().round())]) and k.time == 2 / 15
    some = frames.sampled(frames.read_frames(spark, str(tmp_path / "a.rgb"), 8, 6), 0.0, 0.2, 3)
    assert sorted(r.frame for r in some.collect()) == [0, 3, 6]
    assert frames.files(spark, str(tmp_path), "*.rgb").count() == 2


def test_detections_of_raw_frames(spark, tmp_path):
    im = np.zeros((60, 80, 3), np.uint8)
    im[20:40, 30:50] = (240, 220, 240)
    (tmp_path / "v.rgb").write_bytes(im.tobytes() * 2)
    got = parts.notes(frames.read_frames(spark, str(tmp_path / "v.rgb"), 80, 60)).collect()
    assert [(r.frame, r.kind, r.x, r.y) for r in sorted(got)] == [(0, "tap", 39.5, 29.5), (1, "tap", 39.5, 29.5)]


def test_uploads(spark):
    rows = [(100, 0.8, 160), (0, 0.8, 160), ((2 << 30) + 1, 0.8, 160), (5, 0.2, 160), (5, 0.5, 300), (5, None, 160)]
    df = spark.createDataFrame(rows, "n long, y double, t int")
    assert [r.ok for r in df.select(frames.valid_upload(F.col("n"), F.col("y"), F.col("t")).alias("ok")).collect()] == [True] + [False] * 5


def test_package():
    files = {"chart.js": b"x" * 1000, "report.json": b"{}", "empty.txt": b""}
    z = package.pack(files)
    assert z == package.pack(dict(reversed(files.items()))) and package.missing(z, ["chart.js", "empty.txt", "cover.png"]) == ["empty.txt", "cover.png"]
    with pytest.raises(ValueError):
        package.pack({"chart.js": b"x" * (package.LIMIT + 1)})


def double(df, by=2):
    return df.withColumn("x", F.col("x") * by)


def total(df, other):
    return df.join(other.withColumnRenamed("x", "y"), "k").agg(F.sum(F.col("x") + F.col("y")).alias("s"))


def test_runs_resume(spark, tmp_path):
    source = spark.createDataFrame([(k, k * 10) for k in range(5)], "k long, x long")

    def run(key, by):
        r = Run(spark, str(tmp_path / "run"), source, key)
        r.stage("double", double, "source", by=by)
        out = r.stage("total", total, "double", "source").first().s
        return out, json.loads(r.progress())

    assert run("v1", 2) == (300, {"stages": ["double", "total"], "reused": []})
    assert run("v1", 2) == (300, {"stages": ["double", "total"], "reused": ["double", "total"]})
    assert run("v1", 3) == (400, {"stages": ["double", "total"], "reused": []})
    assert run("v2", 2)[1]["reused"] == []
    r = Run(spark, str(tmp_path / "run"), source, "v1", resume=False)
    r.stage("double", double, "source", by=2)
    assert json.loads(r.progress())["reused"] == [] and r.manifest().where("stage = 'double' AND rows = 5").count() >= 3


def test_batch(spark):
    runs = spark.createDataFrame([("b", None), ("a", "x" * 300), ("c", None)], "video string, error string")
    assert [(r.video, r.state, len(r.detail)) for r in batch_report(runs).collect()] == [("b", "done", 0), ("c", "done", 0), ("a", "failed", 120)]
    todo = tables.unfinished(spark.createDataFrame([("a",), ("b",)], "video string"), runs.where("error IS NULL").select("video"))
    assert [r.video for r in todo.collect()] == ["a"]


def test_stage_files(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", [[1.0, 2.0]]), (1, "a", None)], "id long, name string, path array<array<double>>")
    for kind in ("json", "parquet"):
        tables.write_stage(df, str(tmp_path / kind), kind)
        back = tables.read_stage(spark, str(tmp_path / kind), "id long, name string, path array<array<double>>", kind)
        assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    tables.write_stage(df, str(tmp_path / "csv"), "csv", ["name", "id", "path"])
    text = sorted(line for p in (tmp_path / "csv").glob("*.csv") for line in p.read_text().splitlines()[1:])
    assert text == ["a,1,", 'b,2,"[[1.0,2.0]]"'] or text == ["a,1,\"\"", 'b,2,"[[1.0,2.0]]"'] or text[1] == 'b,2,"[[1.0,2.0]]"'
