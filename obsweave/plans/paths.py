"""Distances between paths over the time they share."""
from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import ranged, rows_before
from ..sources.shared import apart, held

MOST, FEWEST = 1 << 18, 1 << 15  # rows of a block; a track that is longer makes a block larger
STEP = 1 << 20  # shared cells that a task looks at together
BLOCK = "block int, first double, last double, data binary"


def overlap_distance(obs: DataFrame, cell: dict[str, float], common: int, least: float, k: int, most: int = MOST, step: int = STEP) -> DataFrame:
    """a, b, med, worst: median and largest distance of the paths of tracks a < b at k even times of their overlap, if that lasts `least` seconds and both have points (t, x) in `common` or more of
    the same cells (cell: widths of t and x). Tracks are dealt to blocks by their begin, and each two blocks whose times overlap meet in one task, which finds the pairs by their cells and takes both
    paths at all times. So what is written is the points, not a row a shared cell, pair or time."""
    points = obs.where("track IS NOT NULL AND t IS NOT NULL").select(F.col("track").cast("long").alias("track"), F.col("t").cast("double").alias("t"), F.col("x").cast("double").alias("x"))
    span = points.groupBy("track").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n")).where(F.col("hi") - F.col("lo") >= least)
    placed = ranged(span, ["lo", "track"])
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part_").orderBy("in_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size = F.least(F.lit(most), F.greatest(F.lit(min(FEWEST, most)), F.ceil(F.col("all_") / 16)))  # few rows: blocks enough for all cores
    dealt = placed.withColumn("inside_", inside).join(F.broadcast(rows_before(placed, F.col("n"))), "part_").select("track", F.floor((F.col("before_") + F.col("inside_")) / size).cast("int").alias("block"))
    n = dealt.agg(F.coalesce(F.max("block") + 1, F.lit(1))).first()[0]
    packed = points.join(apart(dealt), "track").repartitionById(n, "block").groupBy("block").applyInArrow(lambda t: pack(t, cell["t"], cell["x"]), BLOCK)
    blocks = held(packed)
    one, other = (blocks.select(*(F.col(c).alias(f"{c}_{side}") for c in blocks.columns)) for side in "pq")
    both = one.join(other.hint("shuffle_replicate_nl"), (F.col("block_p") <= F.col("block_q")) & (F.least("last_p", "last_q") - F.greatest("first_p", "first_q") >= least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for same, p, q in zip(*(b.column(c) for c in ("same", "data_p", "data_q"))):
                for found in meet(unpacked(p), unpacked(q), same.as_py(), common, least, k, step):
                    yield pa.RecordBatch.from_arrays(found, ["a", "b", "med", "worst"])

    return both.select((F.col("block_p") == F.col("block_q")).alias("same"), "data_p", "data_q").mapInArrow(run, "a long, b long, med double, worst double")


def pack(rows: pa.Table, wide: float, high: float) -> pa.Table:
    """A row of BLOCK: tracks by id with their times, the greatest x of each time (nulls marked), and the tracks of each cell."""
    ids, owner = np.unique(rows["track"].to_numpy(), return_inverse=True)
    t, none = rows["t"].to_numpy(), rows["x"].is_null().to_numpy()
    x = np.where(none, np.nan, rows["x"].to_numpy())
    order = np.lexsort((x, ~none, t, owner))
    last = order[np.append((np.diff(owner[order]) != 0) | (np.diff(t[order]) != 0), True)]
    starts = np.searchsorted(owner[last], np.arange(len(ids) + 1))
    f, g, who = (np.floor(t / wide) + 0.0)[~none], (np.floor(x / high) + 0.0)[~none], owner[~none]
    g[np.isnan(g)] = np.finfo(float).max  # a cell like any other, which no number has
    order = np.lexsort((who, g, f))
    f, g, who = f[order], g[order], who[order]
    new = np.append(True, (np.diff(f) != 0) | (g[1:] != g[:-1]) | (np.diff(who) != 0))[: len(who)]
    data = io.BytesIO()
    np.savez(data, ids=ids, starts=starts, t=t[last], x=x[last], none=none[last], f=f[new], g=g[new], who=who[new].astype(np.int32))
    return pa.table([rows["block"][:1], [t.min()], [t.max()], [data.getvalue()]], schema=pa.schema([("block", pa.int32()), ("first", pa.float64()), ("last", pa.float64()), ("data", pa.binary())]))


def unpacked(data: pa.BinaryScalar) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(data.as_buffer())))


def meet(p: dict, q: dict, same: bool, common: int, least: float, k: int, step: int) -> Iterator[list[pa.Array]]:
    """a, b, med and worst of the pairs of a track of p and one of q; same: of one block."""
    for a, b in sharing(p, q, common, step):
        if same:
            a, b = a[a < b], b[a < b]
        lo = np.maximum(p["t"][p["starts"][a]], q["t"][q["starts"][b]])
        hi = np.minimum(p["t"][p["starts"][a + 1] - 1], q["t"][q["starts"][b + 1] - 1])
        long = np.flatnonzero(hi - lo >= least)
        for i in range(0, len(long), step // 8 or 1):
            some = long[i : i + (step // 8 or 1)]
            m, n = a[some], b[some]
            at = lo[some, None] + (hi - lo)[some, None] * np.arange(k) / (k - 1)
            order = np.argsort(n, kind="stable")
            v, gone = taken(p, m, at)
            there = np.empty_like(order)
            there[order] = np.arange(len(order))
            w, lost = (c[there] for c in taken(q, n[order], at[order]))
            with np.errstate(invalid="ignore"):
                med, worst, none = middle_and_most(np.abs(v - w), gone | lost)
            ids = p["ids"][m], q["ids"][n]
            yield [pa.array(np.minimum(*ids)), pa.array(np.maximum(*ids)), pa.array(med, mask=none, from_pandas=False), pa.array(worst, mask=none, from_pandas=False)]


def sharing(p: dict, q: dict, common: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tracks of p, ascending, and of q with `common` or more cells in common. A cell's tracks are spread out for some tracks of p at a time."""
    places = lambda s: np.stack([s["f"], s["g"]], 1).view(complex).ravel()
    cells, begins, sizes = np.unique(places(q), return_index=True, return_counts=True)
    if not len(cells) or not len(p["f"]):
        return
    mine, wide = places(p), len(q["ids"])
    hit = np.minimum(np.searchsorted(cells, mine), len(cells) - 1)
    rows = np.flatnonzero(cells[hit] == mine)
    rows = rows[np.argsort(p["who"][rows], kind="stable")]
    who, begin, n = p["who"][rows].astype(np.int64), begins[hit[rows]], sizes[hit[rows]]
    upto = np.append(0, np.cumsum(n))
    of = np.searchsorted(who, np.arange(len(p["ids"]) + 1))
    sums = upto[of]
    large = np.diff(sums) > step  # a long track is alone, and its cells come some at a time
    cuts = np.flatnonzero((np.diff(sums[:-1] // step) != 0) | large[1:] | large[:-1]) + 1
    for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(large)]):
        parts = np.unique(np.append(np.searchsorted(upto, np.arange(sums[a], sums[z], step)), of[z])) if large[a] else of[[a, z]]
        seen = None
        for r0, r1 in zip(parts[:-1], parts[1:]):
            m = n[r0:r1]
            key = np.repeat((who[r0:r1] - a) * wide, m) + q["who"][np.arange(upto[r1] - upto[r0]) + np.repeat(begin[r0:r1] - (upto[r0:r1] - upto[r0]), m)]
            if large[a] or (z - a) * wide <= 4 * step:
                add = np.bincount(key, minlength=(z - a) * wide)
                seen = add if seen is None else seen + add
            else:  # few cells of many tracks
                key, times = np.unique(key, return_counts=True)
                yield key[times >= common] // wide + a, key[times >= common] % wide
        if seen is not None:
            key = np.flatnonzero(seen >= common)
            yield key // wide + a, key % wide


def taken(s: dict, who: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of tracks (ascending) at rows of times, none before a track's first: linear between points and constant after the last; and where a point without a value makes it null."""
    t, x, starts = s["t"], s["x"], s["starts"]
    before = np.empty(at.shape, np.int64)
    cuts = (np.flatnonzero(np.diff(who)) + 1).tolist()
    for i, j in zip([0, *cuts], [*cuts, len(who)]):
        a, z = starts[who[i]], starts[who[i] + 1]
        before[i:j] = np.searchsorted(t[a:z], at[i:j], side="right") + (a - 1)
    after = np.minimum(before + 1, (starts[who + 1] - 1)[:, None])
    t0, x0 = t[before], x[before]
    exact = (t0 == at) | (after == before)
    with np.errstate(all="ignore"):
        v = np.where(exact, x0, x0 + (x[after] - x0) * (at - t0) / (t[after] - t0))
    return v, s["none"][before] | ~exact & s["none"][after]


def middle_and_most(d: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Median and largest of each row without what is gone, and rows without any; NaN is the largest number."""
    left = d.shape[1] - gone.sum(1)
    med, worst = np.zeros(len(d)), np.zeros(len(d))
    for n in np.unique(left[left > 0]):
        rows = left == n
        v = np.sort(d[rows][~gone[rows]].reshape(-1, n), axis=1)
        low, high = v[:, (n - 1) // 2], v[:, n // 2]
        med[rows], worst[rows] = np.where(low == high, low, (low + high) / 2), v[:, -1]
    return med, worst, left == 0
