"""Allocation under count constraints."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def allocate(atoms: list[tuple[tuple[int, ...], float]], wanted: list[int]) -> list[bool] | None:
    """Exact 0/1 allocation: which candidates to choose so that interval i gets wanted[i] atoms, with the largest total score; None if impossible.

    atoms: for each candidate the intervals its atoms fall into, and its score. Dynamic program over candidates in order of their first interval; the state is
    what intervals still open have got, so its size is bounded by intervals that one candidate spans."""
    order = sorted(range(len(atoms)), key=lambda k: (min(atoms[k][0], default=0), k))
    last_use = {}
    for pos, k in enumerate(order):
        for i in atoms[k][0]:
            last_use[i] = pos
    if any(n and i not in last_use for i, n in enumerate(wanted)):
        return None
    states: dict[tuple, tuple[float, tuple]] = {(): (0.0, ())}
    for pos, k in enumerate(order):
        spans, score = atoms[k]
        nxt: dict[tuple, tuple[float, tuple]] = {}
        for state, (value, chosen) in states.items():
            for take in (False, True):
                got = dict(state)
                if take:
                    for i in spans:
                        got[i] = got.get(i, 0) + 1
                    if any(got[i] > wanted[i] for i in spans):
                        continue
                closing = [i for i in set(spans) if last_use[i] == pos]
                if any(got.get(i, 0) != wanted[i] for i in closing):
                    continue
                key = tuple(sorted((i, n) for i, n in got.items() if last_use[i] > pos))
                new = (value + score * take, (k, chosen) if take else chosen)
                if key not in nxt or new[0] > nxt[key][0] + 1e-12:
                    nxt[key] = new
        states = nxt
        if not states:
            return None
    out, node = [False] * len(atoms), states[()][1] if () in states else ()
    while node:
        out[node[0]] = True
        node = node[1]
    return out


def allocate_table(obs: DataFrame, width: float = 5 * 86400.0) -> DataFrame:
    """track, candidates, chosen, score, feasible: for each track, candidates may last (two atoms), and each interval wants two atoms fewer than there are."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["t", "id"])
        base = int(pdf.t.min() // width)
        spans, scores = [], []
        for t, x, y in zip(pdf.t, pdf.x, pdf.y):
            i = int(t // width) - base
            j = int((t + (43200 if y % 3 == 0 else 0)) // width) - base
            spans.append((i, j) if y % 3 == 0 else (i,))
            scores.append(float(x))
        n = max(max(s) for s in spans) + 1
        have = [sum(s.count(i) for s in spans) for i in range(n)]
        wanted = [max(h - 2, 0) for h in have]
        got = allocate(list(zip(spans, scores)), wanted)
        return pd.DataFrame({"track": [pdf.track.iloc[0]], "candidates": [len(pdf)], "chosen": [sum(got) if got else 0], "score": [round(sum(s for s, g in zip(scores, got) if g), 4) if got else 0.0], "feasible": [got is not None]})

    return obs.groupBy("track").applyInPandas(run, "track long, candidates long, chosen long, score double, feasible boolean")


def check_decreasing(df: DataFrame) -> bool:
    return df.where(F.col("after") > F.col("before")).isEmpty()
