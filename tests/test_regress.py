"""Fits by grouped sums against numpy, and segments of drawn lines."""
import numpy as np
from pyspark.sql import functions as F

from obsweave.operators import paths, regress
from obsweave.operators.segments import segments


def test_least_squares_equals_lstsq(spark):
    rng = np.random.default_rng(6)
    k, rows, want = 11, [], {}
    for key, n in ((1, 400), (2, 30), (3, 5), (None, 40)):
        x = rng.normal(0, 1, (n, k)) * 10.0 ** rng.integers(-2, 3, k)
        if key == 2:
            x[:, 4] = 2 * x[:, 1]  # depends on another
        y = x @ rng.normal(0, 3, k) + rng.normal(0, 0.1, n)
        want[key] = np.linalg.lstsq(x, y, rcond=1e-9)[0], x, y
        rows += [(key, float(b), *a) for a, b in zip(x.tolist(), y)]
    df = spark.createDataFrame(rows, "key long, y double, " + ", ".join(f"x{i} double" for i in range(k)))
    got = {}
    for r in regress.least_squares(df, ["key"], F.col("y"), [F.col(f"x{i}") for i in range(k)]).collect():
        got.setdefault(r.key, {})[r.i] = r.b
    assert got.keys() == want.keys()
    for key, (b, x, y) in want.items():
        mine = np.array([got[key][i] for i in range(k)])
        if key in (1, None):
            assert np.allclose(mine, b, rtol=1e-6, atol=1e-8)
        else:  # many answers: as near, and not longer
            assert np.linalg.norm(x @ mine - y) <= np.linalg.norm(x @ b - y) + 1e-4 and np.linalg.norm(mine) <= np.linalg.norm(b) * 1.01
    assert regress.least_squares(df.limit(0), ["key"], F.col("y"), [F.col("x0")]).collect() == []


def test_robust_lines_equal_a_loop(spark):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for key in range(3):
        t = rng.uniform(0, 10, 60)
        y = 2 * key - 0.5 * key * t + rng.normal(0, 0.05, 60)
        y[:12] += rng.uniform(5, 90, 12)
        rows += [(key, float(a), float(b)) for a, b in zip(t, y)]
        d, w = t - t.mean(), np.ones(60)
        for _ in range(7):
            s = (w.sum() * (w * d * y).sum() - (w * d).sum() * (w * y).sum()) / (w.sum() * (w * d * d).sum() - (w * d).sum() ** 2)
            level = ((w * y).sum() - s * (w * d).sum()) / w.sum()
            off = np.abs(y - level - s * d)
            w = np.where(off <= 0.2, 1, 0.2 / np.maximum(off, 1e-12))
        want[key] = (s, level)
    rows += [(9, 1.0, 1.0), (9, 1.0, 2.0), (8, None, 3.0)]  # one time only
    got = {r.key: r for r in regress.robust_lines(spark.createDataFrame(rows, "key long, t double, y double"), ["key"], "t", "y", 0.2).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k].slope - s) < 1e-6 and abs(got[k].level - v) < 1e-6 and 0.7 < got[k].inside < 0.85 for k, (s, v) in want.items())


def test_segments(spark):
    points = [(x, 40) for x in range(10, 60)] + [(x, 40) for x in range(80, 130)] + [(90, y) for y in range(0, 36)] + [(200, 200)]
    p = spark.createDataFrame([(1.0 * x, y) for x, y in points], "px double, py int")
    got = sorted((r.th, r.rho, round(r.u0), round(r.u1)) for r in segments(p, paths.hough(p, 90, 20), 90, 3.0, 20.0).collect())
    assert {(0, 90, 0, 35), (45, 40, -129, -80), (45, 40, -59, -10)} <= set(got) and not any(g[:2] == (45, 40) for g in set(got) - {(45, 40, -129, -80), (45, 40, -59, -10)})
    assert segments(p.limit(0), paths.hough(p.limit(0), 90, 20), 90, 3.0, 20.0).collect() == []
