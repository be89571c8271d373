import hashlib
import math

import numpy as np
import pytest

from obsweave.llm import vafile

COLS = "vec_id long, embedding array<float>, label int, vec_ID2 string"


def brute(rows):
    """The contract by plain loops in Python integers."""
    usable = lambda v: v and len(v) % 8 == 0 and all(x is not None and math.isfinite(x) for x in v)
    v = [(i, [math.floor(4096 * float(np.float32(x))) for x in e], lab) for i, e, lab in rows if usable(e)]
    v.sort(key=lambda r: (r[0] is None, r[0] or 0))
    v = [r for r in v if len(r[1]) == len(v[0][1])]
    if not v:
        return []
    w = len(v[0][1]) // 8
    cut = lambda q, p: q[p * w : (p + 1) * w]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[cut(q, p) for _, q, _ in v[:16]] for p in range(8)]
    near = lambda q, p: min((far(cut(q, p), b), k) for k, b in enumerate(books[p]))
    for _ in range(6):
        new = []
        for p in range(8):
            mine = [[] for _ in books[p]]
            for _, q, _ in v:
                mine[near(q, p)[1]].append(cut(q, p))
            new.append([[sum(c) // len(m) for c in zip(*m)] if m else b for m, b in zip(mine, books[p])])
        books = new
    out = []
    for i, q, lab in v:
        best = [near(q, p) for p in range(8)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), lab))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    total = {}
    for *_, e, lab in out:
        total[lab] = total.get(lab, 0) + e
    return sorted(((i, c, e, total[lab], sha) for i, c, e, lab in out), key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], COLS)
    return sorted((tuple(r) for r in vafile.codes(df).collect()), key=repr)


def test_op13_equals_a_full_search(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 16)], int(i % 3) if i % 5 else None) for i in rng.permutation(90)]
    rows += [(rows[4][0] + 200, rows[4][1], 1), (301, None, 1), (302, [0.1] * 15 + [None], 1), (303, [0.1] * 15 + [math.nan], 0), (304, [math.inf] * 16, 0), (305, [], 2), (306, [0.5] * 7, 2), (307, [0.5] * 24, 2), (308, [40000.0, -40000.0] * 8, 2)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_op13_few_vectors(spark, n):
    rows = [(7, [0.25] * 8, None)] * n  # repeated rows: nothing but ties
    assert run(spark, rows) == brute(rows)


def test_op13_bounds_hold_and_filter():
    rng = np.random.default_rng(1)
    book, parts = rng.integers(-900, 900, (16, 8)), rng.integers(-2000, 2000, (300, 8))
    cells = vafile.Cells(book)
    full = ((parts[:, None] - book) ** 2).sum(2)
    low, high = cells.bounds(parts)
    assert (low <= full).all() and (full <= high).all()
    entry, far, measured = cells.nearest(parts)
    assert (entry == full.argmin(1)).all() and (far == full.min(1)).all() and measured < full.size / 3
