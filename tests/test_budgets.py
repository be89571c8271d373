import math
import random

from obsweave.operators.budgets import budgeted

OFFER = "track long, slot long, item long, score double, t double, x double, y double"


def loop(offers, budgets):
    """All offers one by one."""
    taken, spent = [], {}
    for o in sorted(offers, key=lambda o: (o[0], o[1], o[3], o[2])):
        track, slot, item, _, t, x, y = o
        if spent.get((track, slot), 0) >= budgets.get((track, slot), 0):
            continue
        if any(p[0] == track and (p[2] == item or (abs(p[4] - t) < 0.018 and math.hypot(p[5] - x, p[6] - y) < 28)) for p in taken):
            continue
        taken.append(o)
        spent[track, slot] = spent.get((track, slot), 0) + 1
    return sorted(taken)


def test_rounds_equal_the_loop(spark):
    rng = random.Random(8)
    offers = set()
    for track in range(3):
        for item in range(90):
            t = rng.uniform(0, 1)
            for slot in {math.floor((t - 0.05) * 4), math.floor((t + 0.05) * 4)}:
                offers.add((track, slot, item, round(rng.uniform(-3, 0), 2), round(t, 3), rng.uniform(-60, 60), rng.uniform(-40, 40)))
    budgets = {(track, slot): rng.randrange(8) for track in range(3) for slot in range(-1, 5)}
    got = budgeted(spark.createDataFrame(sorted(offers), OFFER), spark.createDataFrame([(*k, v) for k, v in budgets.items()], "track long, slot long, budget long"), "track", "slot", "item", ["score"], "t", ["x", "y"], 0.018, 28.0)
    want = loop(offers, budgets)
    assert sorted(tuple(r) for r in got.collect()) == want and 20 < len(want) < sum(budgets.values())


def test_copies_in_one_place_and_nothing(spark):
    rows = [(1, 0, k, 0.0, 0.5, 1.0, 1.0) for k in range(300)]  # all suppress each other
    b = spark.createDataFrame([(1, 0, 5)], "track long, slot long, budget long")
    args = (b, "track", "slot", "item", ["score"], "t", ["x", "y"], 0.018, 28.0)
    assert [r.item for r in budgeted(spark.createDataFrame(rows, OFFER), *args).collect()] == [0]
    assert budgeted(spark.createDataFrame([], OFFER), *args).collect() == []
