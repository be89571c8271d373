"""The joint fit against enumeration of all choices, and its options against the rules."""
import itertools
import random

import pytest

from obsweave.plans import joint_fit

OPT = "track long, event long, opt int, head int, tail int, moved_head double, moved_tail double, cost double"
GRID = "track long, interval long, end double, expected long"


def enumerated(options, expected):
    """Least cost over all choices; options: {event: [(cost, atoms)]}."""
    best = {True: None, False: None}
    for pick in itertools.product(*([None, *o] for o in options.values())):
        got = [0] * len(expected)
        cost = 0.0
        for p in filter(None, pick):
            cost += p[0]
            for i in p[1]:
                got[i] += 1
        off = [e - g for e, g in zip(expected, got)]
        strict = not any(off)
        carried = list(itertools.accumulate(off))
        cost += sum(300000.0 * abs(x) for x in off) + sum(200000.0 * abs(x) for x in carried)
        if best[strict] is None or cost < best[strict]:
            best[strict] = cost
    return (best[True], True) if best[True] is not None else (best[False], False)


def made(seed, intervals, events):
    rng = random.Random(seed)
    expected = [rng.choice([0, 1, 1, 2]) for _ in range(intervals)]
    options = {}
    for e in range(events):
        at, o = rng.randrange(intervals), []
        for _ in range(rng.randrange(1, 4)):
            head = min(intervals - 1, max(0, at + rng.choice([-1, 0, 0, 1])))
            tail = min(intervals - 1, head + rng.randrange(0, 6)) if rng.random() < 0.4 else -1
            atoms = [i for i in (head, tail) if i >= 0]
            if all(expected[i] for i in atoms):
                o.append((round(rng.uniform(-9, 3), 3), atoms, head, tail))
        if o:
            options[e] = o
    return expected, options


@pytest.mark.parametrize("size", [2, 3, 50])
def test_fit_equals_enumeration(spark, size):
    cases = {k: made(k, 5 + k % 5, 4 + k % 4) for k in range(16)}
    grid = [(k, i, float(i + 1), n) for k, (e, _) in cases.items() for i, n in enumerate(e)]
    rows = [(k, e, j + 1, o[2], o[3], 0.0, 0.0, o[0]) for k, (_, opts) in cases.items() for e, v in opts.items() for j, o in enumerate(v)]
    intervals = spark.createDataFrame(grid, GRID)
    chosen, costs = joint_fit.fit(spark.createDataFrame(rows, OPT), intervals, size)
    want = {k: enumerated({e: [(o[0], o[1]) for o in v] for e, v in opts.items()}, exp) for k, (exp, opts) in cases.items()}
    got = {r.track: (r.cost, r.strict) for r in costs.collect()}
    assert {k: s for k, (_, s) in got.items()} == {k: s for k, (_, s) in want.items()} and {s for _, s in want.values()} == {True, False}
    assert all(abs(got[k][0] - want[k][0]) < 1e-4 for k in want)
    picks = chosen.collect()
    assert len({(r.track, r.event) for r in picks}) == len(picks)
    carried = {}
    for r in joint_fit.cumulative(chosen, intervals).collect():
        carried.setdefault(r.track, []).append((r.expected - r.got, r.carried))
    for k, x in carried.items():  # the chosen options have the cost that the fit says
        own = sum(r.cost for r in picks if r.track == k)
        assert abs(own + sum(300000 * abs(o) + 200000 * abs(c) for o, c in x) - want[k][0]) < 1e-4


def test_options_follow_the_rules(spark):
    intervals = spark.createDataFrame([(1, 0, 1.0, 1), (1, 1, 2.0, 0), (1, 2, 3.0, 2)], GRID)
    events = [
        (1, 1, 1.05, 0.0, 5.0, None, None, False),  # in a quiet interval, but within reach of the edge before it
        (1, 2, 2.5, 0.0, 1.0, 2.45, 2.45, True),  # pinned
        (1, 3, 2.4, 0.3, 2.0, None, 2.4, True),  # measured: one step either way, head and tail
        (1, 4, 1.5, 0.0, 9.0, None, None, False),  # quiet, far from edges
        (1, 5, 3.05, 0.0, 9.0, None, None, False),  # behind the counter, within reach of its end
    ]
    e = spark.createDataFrame(events, "track long, event long, time double, duration double, quality double, pin double, contact double, held boolean")
    rows = joint_fit.fit_options(e, intervals).collect()
    by = {k: sorted((round(r.moved_head, 5), round(r.moved_tail, 5)) for r in rows if r.event == k) for k in range(1, 6)}
    assert by[1] == [(-0.06667, 0.0), (-0.051, 0.0)] and by[2] == [(-0.05, 0.0)] and by[4] == [] and by[5] == [(-0.06667, 0.0), (-0.051, 0.0)]
    assert by[3] == [(a, b) for a in (-0.03333, 0.0, 0.03333) for b in (-0.03333, 0.0, 0.03333)]
    assert {r.opt: (r.head, r.tail) for r in rows if r.event == 3} == {k: (2, 2) for k in range(1, 10)}
    cost = {(r.event, r.moved_head, r.moved_tail): r.cost for r in rows}
    assert cost[3, 0.0, 0.0] == -2.0 and abs(cost[3, 0.03333, 0.0] - (0.03333 * (25 + 85) - 2)) < 1e-6 and abs(cost[2, -0.05, 0.0] - (0.05 * 25 - 1)) < 1e-6


def test_matrices_have_the_costs_of_all_walks():
    rng = random.Random(3)
    for case in range(60):
        first, size = rng.choice([0, 8]), rng.randrange(1, 6)
        rows = [(2, -1, 0, i, -1, i, float(rng.choice([0, 1, 1, 2, 3]))) for i in range(first, first + size)]
        for event in range(rng.randrange(6)):
            lo = rng.randrange(first, first + size)
            for opt in range(rng.randrange(1, 4)):
                head = lo + rng.randrange(2)
                rows.append((0, event, opt, head, rng.choice([-1, head + rng.randrange(5)]), lo, round(rng.uniform(-9, 3), 3)))
        rows += [(1, 100 + e, o, first - 1, first + rng.randrange(size + 2), first - 1, 0.0) for e in range(rng.randrange(3)) for o in range(2) if first]
        for reach, strict in ((0, True), (1, False), (2, False), (5, False)):
            want = {way: cost for way, (cost, _) in joint_fit.walk(rows, reach, strict).items()}
            got = joint_fit.matrix(rows, reach, strict)
            assert {(a, z, x): cost for a, z, x, cost in got} == want and len(got) == len(want), (case, reach)
