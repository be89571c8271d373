"""A script written in parts against one made line by line on the driver."""
import random

import numpy as np

from obsweave.operators.curves import simplify
from obsweave.sources import script

NOTE = "video long, id long, time double, duration double, kind string, fake boolean"
POINT = "video long, id long, t double, x double, y double"
EFFECT = "video long, id long, kind string, start double, end double, alpha double"


def reference(video, title, notes, points, effects):
    out = ["# reconstruction from video", f"title {title}", "timing 0 60 4"]
    path = {}
    for v, i, *q in points:
        if v == video:
            path.setdefault(i, []).append(q)
    rows = []
    for v, i, time, duration, kind, fake in notes:
        if v == video:
            p = sorted(path.get(i, []))
            end = max(time + duration, p[-1][0] + 1 / 30) if fake and p else time + duration
            rows.append((min(p[0][0], time) if p else max(0, time - 0.6), i, time, end if fake and p and duration <= 0 else time, end, kind, fake, p))
    ends, carrier = {True: [], False: []}, {}
    number, opens = {}, set()
    for start, i, _, _, end, _, fake, _ in sorted(rows, key=lambda r: (r[0], r[1])):
        mine = ends[fake]
        k = next((k for k, e in enumerate(mine) if e + 0.001 < start), len(mine))
        if k == len(mine):
            mine.append(0)
            number[fake, k] = len(number)
            opens.add(i)
        mine[k] = end + 0.55
        carrier[i] = number[fake, k]
    for start, i, time, hit, end, kind, fake, p in sorted(rows, key=lambda r: (r[2], r[1])):
        if i in opens:
            out.append(f"line {carrier[i]}")
        out.append(f"note {carrier[i]} {i} {hit:.5f} {max(hit, end):.5f} {kind} {'fake' if fake else 'real'}")
        if p:
            t, v = np.array([q[0] for q in p]), np.array([q[1:] for q in p])
            k = simplify(t, v, np.array([1.5, 1.5]))
            out.append("path " + " ".join(f"{a:.5f}:{x:.3f},{y:.3f}" for a, (x, y) in zip(t[k], v[k])))
        edge = max(0.0, start - 2e-5)
        out.append(f"show {edge:.5f}:0 {edge + 1e-5:.5f}:1 {end:.5f}:1 {end + 1e-5:.5f}:0")
    for v, i, kind, a, z, alpha in sorted(effects, key=lambda e: (e[3], e[1])):
        if v == video:
            out.append(f"effect {kind} {i} {a:.5f} {z:.5f} {alpha:.3f}")
    return "".join(f"{x}\n" for x in out).encode()


def test_script_in_parts(spark, tmp_path):
    rng = random.Random(5)
    notes, points, effects = [], [], []
    for i in range(120):
        video, time, fake = 1 + i % 2, round(rng.uniform(1, 40), 3), rng.random() < 0.3
        notes.append((video, i, time, rng.choice([0.0, 0.0, 0.75]), rng.choice(["tap", "drop"]), fake))
        if rng.random() < 0.8:
            bend = rng.uniform(-300, 300)
            points += [(video, i, round(time - 0.5 + k / 30, 4), 600 + bend * (k / 12) ** 2, 40.0 * k) for k in range(12)]
    effects = [(1, i, rng.choice(["target", "rail", "é"]), round(rng.uniform(0, 40), 3), 41.0, rng.random()) for i in range(30)]
    lines = script.chart(1, "Étude No. 1", spark.createDataFrame(notes, NOTE), spark.createDataFrame(points, POINT), spark.createDataFrame(effects, EFFECT))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many parts as there would be of a long script
    try:
        script.write_script(lines, str(tmp_path / "s"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = reference(1, "Étude No. 1", notes, points, effects)
    parts = list(script.script_bytes(spark, str(tmp_path / "s")))
    assert b"".join(parts).decode().split("\n") == want.decode().split("\n")
    index = sorted(tuple(r) for r in script.read_index(spark, str(tmp_path / "s")).collect())
    assert len(index) > 3 and sum(n for _, n, _, _ in index) == want.count(b"\n")
    for _, n, size, offset in index:
        assert want[offset : offset + size].count(b"\n") == n and want[offset + size - 1 : offset + size] == b"\n"
    assert [size for *_, size, _ in index] == [len(p) for p in parts if p]
