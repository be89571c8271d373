"""Every observation query against its SQL in DuckDB, and the sequential operators against brute force."""

import glob
import itertools
import os

import numpy as np
import pytest

duckdb = pytest.importorskip("duckdb")

from obsweave.operators import curves, solve, tracking
from obsweave.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    show = lambda v: None if v is None else repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(show(x[k]) for k in order) for x in data), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, DATA), duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_slots_equal_a_loop(spark):
    from obsweave.sources.tables import observations

    got = {(r.track, r.id): r.slot for r in QUERIES["q35_slot_pool"](spark, DATA).collect()}
    by = {}
    for r in observations(spark, DATA).collect():
        by.setdefault(r.track, []).append((r.t, r.id, r.t + r.x * 600))
    for track, events in by.items():
        ends = []
        for s, i, e in sorted(events):
            k = next((k for k, x in enumerate(ends) if x + 0.001 < s), len(ends))
            ends[k : k + 1] = [e]
            assert got[track, i] == k


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for n, m in itertools.product(range(1, 6), range(1, 6)):
        c = rng.random((n, m))
        best = min(sum(c[i, j] for i, j in zip(range(n), p)) if n <= m else sum(c[i, j] for i, j in zip(p, range(m))) for p in itertools.permutations(range(max(n, m)), min(n, m)))
        pairs = tracking.assign(c)
        assert len(pairs) == min(n, m) and abs(sum(c[p] for p in pairs) - best) < 1e-9


def test_assignment_with_ties_and_gates(monkeypatch):
    """Equal costs and pairs out of reach: the most links, then the least sum; the solver sees only what a gate reaches."""
    rng = np.random.default_rng(2)
    for n, m in itertools.product(range(1, 6), range(1, 6)):
        c = np.where(rng.random((n, m)) < 0.5, 1e6, rng.integers(0, 3, (n, m)))
        best = min(sum(c[i, j] for i, j in zip(range(n), p)) if n <= m else sum(c[i, j] for i, j in zip(p, range(m))) for p in itertools.permutations(range(max(n, m)), min(n, m)))
        pairs = tracking.assign(c)
        assert pairs == sorted(pairs) and len({j for _, j in pairs}) == min(n, m) and abs(sum(c[p] for p in pairs) - best) < 1e-6
    shapes, solve = [], tracking.assign
    monkeypatch.setattr(tracking, "assign", lambda c: shapes.append(c.shape) or solve(c))
    rows = [(f, f * 100 + k, 1000.0 * (k + 50 * f * (k > 1)), 0.0) for f in (0, 1) for k in range(40)]
    links = dict(tracking.Tracker().run(rows))
    assert shapes[-1] == (2, 2) and [links[100], links[101]] == [links[0], links[1]] and len(set(links.values())) == 78


def test_greedy_tracker_takes_the_nearest_in_turn():
    rows = [(0, 1, 0.0, 0.0), (0, 2, 10.0, 0.0), (1, 3, 6.0, 0.0), (1, 4, 12.0, 0.0), (1, 5, 500.0, 0.0)]
    far = tracking.Tracker(gate=11.0)
    assert dict(far.run(rows)) == {1: 0, 2: 1, 3: 0, 4: 1, 5: 2}
    assert dict(tracking.Tracker(gate=11.0, greedy=True).run(rows)) == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3}


def brute_allocate(atoms, wanted):
    """Best total score by enumeration."""
    best = None
    for pick in itertools.product((False, True), repeat=len(atoms)):
        got = [0] * len(wanted)
        for p, (spans, _) in zip(pick, atoms):
            for i in spans:
                got[i] += p
        if got == list(wanted):
            s = sum(a[1] for p, a in zip(pick, atoms) if p)
            best = s if best is None or s > best else best
    return best


def test_allocation_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(60):
        atoms = [(tuple(sorted(rng.integers(0, 4, rng.integers(1, 3)).tolist())), float(rng.integers(1, 9))) for _ in range(8)]
        wanted = rng.integers(0, 4, 4).tolist()
        got, best = solve.allocate(atoms, wanted), brute_allocate(atoms, wanted)
        assert (got is None) == (best is None)
        if got:
            assert abs(sum(a[1] for a, g in zip(atoms, got) if g) - best) < 1e-9


def test_reconciliation_never_worsens(spark):
    assert solve.check_decreasing(QUERIES["q56_reconcile_local"](spark, DATA))


def test_simplified_paths_stay_close(spark):
    assert all(r.worst <= 12.0 for r in QUERIES["q57_curve_simplify"](spark, DATA).collect())


def test_codec_round_trip():
    rng = np.random.default_rng(3)
    for x in (rng.integers(-900, 900, 50) / 100, rng.random(40), np.array([0.0]), np.array([])):
        assert np.array_equal(curves.decode(curves.encode(x)), x)


def test_tracks_are_disjoint_per_frame(spark):
    assert QUERIES["q54_tracker_assignment"](spark, DATA).groupBy("video", "id").count().where("count > 1").isEmpty()
