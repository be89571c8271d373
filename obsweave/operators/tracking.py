"""Linking detections of successive frames to tracks by minimum-cost assignment."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import held


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost assignment of rows to columns (prices of columns as in Jonker and Volgenant, 1987; O(n**3) at worst); pairs in row order.

    Rows first bid for their cheapest column, by the difference to the second; a row that is outbid bids again, up to two bids a row in all. What is left free then takes shortest augmenting paths. A column
    has a price below 0 only if it is assigned, so the sum is least for more columns than rows too."""
    if not cost.size:
        return []
    flip = cost.shape[0] > cost.shape[1]
    a = np.ascontiguousarray(cost.T if flip else cost, float)
    n, m = a.shape
    v, owner, of = np.zeros(m), np.full(m, -1), np.full(n, -1)
    todo, late, most = list(range(n))[::-1], [], 2 * n if m > 1 else 0
    while todo and most:
        i, most = todo.pop(), most - 1
        r = a[i] - v
        j = int(r.argmin())
        first = r[j]
        if owner[j] >= 0 and (same := np.flatnonzero((r == first) & (owner < 0))).size:
            j = int(same[0])  # as cheap, and free
        r[j] = np.inf
        other = int(r.argmin())
        strict = first < r[other]
        if strict:
            v[j] -= r[other] - first
        elif owner[j] >= 0:
            j = other
        k = int(owner[j])
        owner[j], of[i] = i, j
        if k >= 0:
            of[k] = -1
            (todo if strict else late).append(k)
    free = sorted(todo + late)
    for i in free:
        reach, back, low = a[i] - v, np.full(m, i), v.copy()
        seen, dist = [], []
        while True:
            j = int(reach.argmin())
            d = reach[j]
            k = int(owner[j])
            if k < 0:
                break
            seen.append(j)
            dist.append(d)
            more = a[k] - low
            more += d - more[j]
            reach[j], low[j] = np.inf, -np.inf  # settled: never nearer again
            more[j] = np.inf
            np.putmask(back, more < reach, k)
            np.minimum(reach, more, out=reach)
        v[seen] += np.array(dist) - d
        while True:
            k = int(back[j])
            owner[j], of[k], j = k, j, int(of[k])
            if k == i:
                break
    pairs = enumerate(of.tolist())
    return sorted((c, r) for r, c in pairs) if flip else list(pairs)


def nearest_free(cost: np.ndarray) -> list[tuple[int, int]]:
    """Each column in turn takes the cheapest row that is still free, the first of equals; pairs in column order."""
    free, out = np.ones(len(cost), bool), []
    for j in range(cost.shape[1] if len(cost) else 0):
        i = int(np.argmin(np.where(free, cost[:, j], np.inf)))
        if free[i] and cost[i, j] < 1e6:
            free[i] = False
            out.append((i, j))
    return out


@dataclass(frozen=True)
class Tracker:
    """Gate and cost: distance to the predicted place below `gate` + `gate_rate` * dt; a track that meets nothing lives for `keep` frames. With `greedy`,
    detections take the nearest track in turn, not by the least sum."""

    gate: float = 30.0
    gate_rate: float = 1.0
    keep: int = 6
    most_speed: float = 5.0
    greedy: bool = False

    def predict(self, s: list[tuple[int, float, float]], frame: int) -> tuple[float, float]:
        last = s[-1]
        if len(s) < 3:
            return last[1], last[2]
        old = s[-3]
        dt = max(last[0] - old[0], 1)
        return tuple(last[k] + float(np.clip((last[k] - old[k]) / dt, -self.most_speed, self.most_speed)) * (frame - last[0]) for k in (1, 2))

    def step(self, active: list[dict], frame: int, found: list[tuple[int, float, float]], next_id: int) -> tuple[list[dict], list[tuple[int, int]], int]:
        """One frame: the tracks now active, (detection, track) for each detection, and the next free number."""
        active = [tr for tr in active if frame - tr["s"][-1][0] <= self.keep]  # frames without detections have passed too
        cost = np.full((len(active), len(found)), 1e6)
        if active and found:
            at = np.array([self.predict(tr["s"], frame) for tr in active], float)
            to = np.array([f[1:] for f in found], float)
            wide = self.gate + self.gate_rate * np.array([frame - tr["s"][-1][0] for tr in active], float)
            dist = np.hypot(*(to[None, :, k] - at[:, None, k] for k in (0, 1)))
            cost = np.where(dist < wide[:, None], dist, 1e6)
        if self.greedy:
            pairs = nearest_free(cost)
        else:  # what no gate reaches has no part in it
            rows, cols = (np.flatnonzero((cost < 1e6).any(k)) for k in (1, 0))
            pairs = [(rows[i], cols[j]) for i, j in assign(cost[np.ix_(rows, cols)])]
        hit = {int(j): int(i) for i, j in pairs if cost[i, j] < 1e6}
        out, links, kept = [], [], []
        for j, (d, x, y) in enumerate(found):
            if j in hit:
                tr = active[hit[j]]
                tr["s"] = [*tr["s"][-2:], (frame, x, y)]
            else:
                tr, next_id = {"id": next_id, "s": [(frame, x, y)]}, next_id + 1
            out.append(tr)
            links.append((d, tr["id"]))
        met = set(hit.values())
        kept = [tr for i, tr in enumerate(active) if i not in met and frame - tr["s"][-1][0] < self.keep]
        return out + kept, links, next_id

    def run(self, rows: list[tuple[int, int, float, float]]) -> list[tuple[int, int]]:
        """(detection, track) for rows (frame, detection, x, y) in order of frame and detection."""
        active, links, next_id, k = [], [], 0, 0
        rows = sorted(rows)
        while k < len(rows):
            e = k
            while e < len(rows) and rows[e][0] == rows[k][0]:
                e += 1
            active, new, next_id = self.step(active, rows[k][0], [x[1:] for x in rows[k:e]], next_id)
            links += new
            k = e
        return links


def track_rows(detections: DataFrame, tracker: Tracker = Tracker()) -> DataFrame:
    """video, id, track_no for detections (video, frame, id, px, py). No track outlives `keep` frames without a detection, so a video falls apart at such gaps; the
    parts are tracked on their own and their numbers follow those of the parts before. Where a video has no gap, it is one group: frames depend on each other."""
    w = Window.partitionBy("video").orderBy("frame", "id")
    gap = F.col("frame") - F.lag("frame").over(w) > tracker.keep
    cut = detections.withColumn("part", F.sum(F.when(gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def run(key, pdf):
        import pandas as pd

        links = tracker.run(list(zip(pdf.frame, pdf.id, pdf.px, pdf.py)))
        return pd.DataFrame({"video": key[0], "part": key[1], "id": [x[0] for x in links], "no": [x[1] for x in links]})

    # a number of its own, for Spark would put all videos of a small table into one task; held, since it is read twice
    tasks = int(detections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = held(cut.repartition(tasks, "video", "part").groupBy("video", "part").applyInPandas(run, "video long, part long, id long, no long"))
    many = local.groupBy("video", "part").agg((F.max("no") + 1).alias("many"))
    before = many.withColumn("before", F.coalesce(F.sum("many").over(Window.partitionBy("video").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(before, ["video", "part"]).select("video", "id", (F.col("no") + F.col("before")).alias("track_no"))
