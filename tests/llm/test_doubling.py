import hashlib
import random
import re

import pytest

from obsweave.llm import doubling


def brute(rows, window=20):
    """The contract by a table of first places; rows that share a doc_id are ordered by the operator's hash of their text."""
    docs = [(i, t or "", re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    assert len({i for i, t, _ in docs}) == len({(i, t) for i, t, _ in docs})
    order = sorted({(i is None, i or 0, t) for i, t, _ in docs})
    first = {}
    for none, i, t in order:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), (none, i, k))
    out = []
    for i, _, w in docs:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] != (i is None, i or 0, k):
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, DOC string, gone int")
    return sorted((tuple(r) for r in doubling.dedup(df, **kw).collect()), key=repr)


def test_op12_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "été", "x y", "the", "End."])
    shared = [" ".join(word() for _ in range(n)) for n in (19, 20, 21, 45, 300)]
    rows = [(k, rng.choice(" \t\n\x0b").join(rng.choice([*shared, " ".join(word() for _ in range(rng.randrange(30)))]) for _ in range(rng.randrange(5)))) for k in rng.sample(range(1000), 120)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (None, rows[3][1]), (2003, "z " * 5000), (2004, "z " * 100 + "y"), (2005, " ".join(str(k) for k in range(30000))), rows[7], rows[7]]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("window", [3, 7, 40])
def test_op12_other_windows(spark, window):
    rng = random.Random(window)
    rows = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(90)))) for k in range(40)]
    assert run(spark, rows, window=window) == brute(rows, window)


def test_op12_nothing_repeats_and_nothing_there(spark):
    rows = [(k, " ".join(f"{k}-{j}" for j in range(50))) for k in range(5)]
    assert run(spark, rows) == brute(rows) and run(spark, []) == []


def test_op12_kept_text(spark):
    df = spark.createDataFrame([(1, "u " * 20 + "v"), (2, "w  " + "u " * 20)], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in doubling.dedup(df, keep_text=True).collect()} == {1: "u " * 20 + "v", 2: "w"}


def test_op12_levels():
    assert doubling.levels(20, 5) == [5, 10, 20] and doubling.levels(7, 5) == [7] and doubling.levels(40, 5) == [5, 10, 20, 40]
