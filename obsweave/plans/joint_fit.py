"""Joint fit of candidate events to a counter: which events count, and by how much their heads and tails move, so that each interval gets the increments that the counter shows.

The best choice along a track is a walk through states at the cuts between intervals: how far the count is off so far, and what tails of holds are still to come. A chunk of intervals
is a matrix in the (min, +) semiring from states at its begin to states at its end, found by one task from the chunk's events alone. Matrices are multiplied in pairs, level by level, as joins; the
best walk through the whole track then settles the states at all cuts on the way down, and each chunk picks its options between two settled states. No task sees a whole track.

A strict fit, every interval exact, comes first. Tracks without one are fitted again with a residual of at most `reach`. What lies beyond is one state on each side, which costs no
more than any residual there; while a walk through such a state is cheaper than all others, the reach doubles, so the answer is the best of all residuals."""
from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import as_of, band_join
from ..sources.shared import apart, held

#: Costs of a unit of residual carried past an interval, and within one.
CARRIED, LOCAL = 200000.0, 300000.0
#: Costs for each second that a head and a tail move.
HEAD_SECOND, TAIL_SECOND = 25.0, 18.0
CHUNK = 8  # intervals
MATRIX = "track long, node long, a string, z string, beyond boolean, cost double"


def moves(events: DataFrame, edges: DataFrame, at: str, step: float, reach: float, inset: float, pinned: str) -> DataFrame:
    """track, event, moved, by: where a time may go. A pinned one goes to its pin; a measured one moves by up to one step, any other by up to two; and unless it is pinned, a time within `reach`
    of an edge may cross it by `inset`."""
    e = events.withColumn("t_", F.col(at))
    wide = F.array(*(F.lit(k * step) for k in (-2, -1, 0, 1, 2)))
    near = F.array(*(F.lit(k * step) for k in (-1, 0, 1)))
    by = F.when(F.col("pin").isNotNull(), F.array(F.col("pin") - F.col(pinned))).when(F.col("contact").isNotNull(), near).otherwise(wide)
    plain = e.select("track", "event", "t_", F.explode(by).alias("by"))
    around = band_join(e.where("pin IS NULL").select("track", "event", "t_"), edges.select("track", F.col("end").alias("t_"), "first", "last"), ["track"], "t_", -reach, reach)
    over = (F.col("t_") < F.col("t__r")) & ~F.col("last_r")  # there is an interval behind the edge
    back = (F.col("t_") > F.col("t__r")) & ~F.col("first_r")
    snap = around.where(over | back).select("track", "event", "t_", (F.col("t__r") + F.when(over, inset).otherwise(-inset) - F.col("t_")).alias("by"))
    return plain.union(snap).select("track", "event", "t_", F.round("by", 5).alias("by")).distinct()


def fit_options(events: DataFrame, intervals: DataFrame, step: float = 1 / 30, reach: float = 0.084, inset: float = 0.001, least: float = 0.015, second: float = 1.0) -> DataFrame:
    """track, event, opt, head, tail (intervals; -1: no tail), moved_head, moved_tail, cost of every option of every event.

    events: track, event, time, duration, quality, pin and contact (or null), held (whether the contact is strong enough to cost). intervals: track, interval from 0, end, expected. An option is dropped if it
    is too short for a hold, touches an interval without increments or lies behind the last one: the counter says that nothing happened there. `second`: what counts as a second in costs."""
    w = Window.partitionBy("track")
    ends = intervals.withColumn("first", F.lit(False)).withColumn("last", F.col("interval") == F.max("interval").over(w))
    starts = intervals.where("interval = 0").select("track", F.lit(0.0).alias("end"), F.lit(True).alias("first"), F.lit(False).alias("last"))
    edges = ends.select("track", "end", "first", "last").union(starts)
    e = events.withColumn("stop", F.col("time") + F.col("duration"))
    heads = moves(e, edges, "time", step, reach, inset, "time").withColumnsRenamed({"by": "moved_head"}).drop("t_")
    strong = e.where("duration > 0").withColumn("pin", F.when(F.col("contact").isNotNull() & F.col("pin").isNotNull(), F.col("stop") + F.col("pin") - F.col("time")))
    tails = moves(strong, edges, "stop", step, reach, inset, "stop").withColumnsRenamed({"by": "moved_tail"}).drop("t_")
    both = e.join(heads, ["track", "event"]).join(tails, ["track", "event"], "left").withColumn("moved_tail", F.coalesce("moved_tail", F.lit(0.0)))
    both = both.withColumn("t", F.round(F.greatest(F.lit(0.0), F.col("time") + F.col("moved_head")), 5)).withColumn("u", F.round(F.col("stop") + F.col("moved_tail"), 5))
    both = both.where((F.col("duration") <= 0) | (F.col("u") >= F.col("t") + least))
    off = F.when(F.col("held"), F.abs(F.col("t") - F.col("contact")) / second * 85).otherwise(0.0)
    both = both.withColumn("cost", F.abs(F.col("moved_head")) / second * HEAD_SECOND + F.abs(F.col("moved_tail")) / second * TAIL_SECOND + F.coalesce(off, F.lit(0.0)) - F.col("quality"))
    grid = intervals.select("track", F.col("end").alias("q_"), "interval", "expected")
    for name, at in (("head", "t"), ("tail", "u")):
        both = as_of(both.withColumn("q_", F.col(at) - 1e-6 * second), grid, ["track"], "q_", ["interval", "expected"], True).drop("q_", "q__r")
        both = both.withColumnsRenamed({"interval_r": name, "expected_r": f"{name}_n"})
    lasting = F.col("duration") > 0
    both = both.where((F.col("head_n") > 0) & (~lasting | (F.col("tail_n") > 0)))  # quiet, or behind the counter
    opt = F.row_number().over(Window.partitionBy("track", "event").orderBy("cost", "moved_head", "moved_tail"))
    return both.select("track", "event", opt.alias("opt"), F.col("head").cast("int").alias("head"), F.when(lasting, F.col("tail")).otherwise(-1).cast("int").alias("tail"), "moved_head", "moved_tail", F.round("cost", 6).alias("cost"))


def chunked(options: DataFrame, intervals: DataFrame, size: int) -> DataFrame:
    """What the task of a chunk needs: its intervals (kind 2, expected as cost), options of events that begin in it (0), and those of earlier events that reach into it (1)."""
    w = Window.partitionBy("track", "event")
    o = options.withColumn("late", F.greatest("head", "tail")).withColumn("early", F.when(F.col("tail") < 0, F.col("head")).otherwise(F.least("head", "tail")))
    o = o.withColumn("lo", F.min("early").over(w)).withColumn("hi", F.max("late").over(w))
    base = ["event", "opt", "head", "tail", "lo", "cost"]
    own = o.select("track", F.floor(F.col("lo") / size).alias("chunk"), F.lit(0).alias("kind"), *base)
    first, last = F.floor(F.col("lo") / size) + 1, F.floor(F.col("hi") / size)
    span = o.where(last >= first).select("track", F.explode(F.sequence(first, last)).alias("chunk"), F.lit(1).alias("kind"), *base)
    grid = intervals.select("track", F.floor(F.col("interval") / size).alias("chunk"), F.lit(2).alias("kind"), F.lit(None).cast("long").alias("event"), F.lit(0).alias("opt"), F.col("interval").cast("int").alias("head"), F.lit(-1).alias("tail"), F.col("interval").cast("int").alias("lo"), F.col("expected").cast("double").alias("cost"))
    return own.unionByName(span).unionByName(grid)


def text(residual: int, pending: tuple) -> str:
    return f"{residual}|" + ",".join(f"{i}:{n}" for i, n in pending)


def state(s: str) -> tuple[int, tuple]:
    residual, _, rest = s.partition("|")
    return int(residual), tuple(tuple(map(int, x.split(":"))) for x in rest.split(",") if x)


def plus(pending: tuple, *atoms: int) -> tuple:
    got = dict(pending)
    for i in atoms:
        got[i] = got.get(i, 0) + 1
    return tuple(sorted(got.items()))


def begins(span: list, first: int, reach: int) -> list[tuple[int, tuple]]:
    """All states that may stand at a chunk's first cut: any residual within reach, and any choice of earlier events' atoms from there on."""
    by = defaultdict(set)
    for event, _, head, tail, _, _ in span:
        by[event].add(tuple(sorted(i for i in (head, tail) if i >= first)))
    pending = {()}
    for atoms in by.values():
        pending |= {plus(p, *a) for p in pending for a in atoms}
    return [(r, p) for r in range(-reach, reach + 1) for p in sorted(pending)]


def onward(r: int, off: int, reach: int, strict: bool) -> list[int]:
    """Residuals that may follow r when an interval is off; reach + 1 and -reach - 1 stand for all beyond."""
    if strict:
        return [0] if not off else []
    far = reach + 1
    if abs(r) < far:
        return [max(-far, min(far, r + off))]
    side = 1 if r > 0 else -1
    back = far + side * off  # the residual, seen from its side, was `far` or more
    return [r, *(side * k for k in range(max(-far, back), far))]


def walk(rows, reach: int, strict: bool, start: list[tuple[int, tuple]] | None = None) -> dict:
    """Cheapest ways through a chunk: {(begin, end, whether it was beyond the reach): (cost, chosen)}, chosen as a chain of (event, opt). rows: (kind, event, opt, head, tail, lo, cost)."""
    grid = {int(r[3]): int(r[6]) for r in rows if r[0] == 2}
    own = defaultdict(lambda: defaultdict(list))
    for kind, event, opt, head, tail, lo, cost in rows:
        if kind == 0:
            own[int(lo)][int(event)].append((cost, int(opt), [int(i) for i in (head, tail) if i >= 0]))
    first = min(grid)
    if start is None:
        start = [(0, ())] if first == 0 else begins([r[1:] for r in rows if r[0] == 1], first, reach if strict else reach + 1)
    now = {(s, *s, abs(s[0]) > reach): (0.0, None) for s in start}
    for i in sorted(grid):
        for event in sorted(own[i]):
            new = dict(now)
            for (s, r, p, x), (cost, chain) in now.items():
                for c, opt, atoms in own[i][event]:
                    q = plus(p, *atoms)
                    if strict and any(n > grid[k] for k, n in q if k in grid):
                        continue
                    if cost + c < new.get((s, r, q, x), (math.inf,))[0]:
                        new[s, r, q, x] = (cost + c, (chain, event, opt))
            now = new
        closed = {}
        for (s, r, p, x), (cost, chain) in now.items():
            off = grid[i] - dict(p).get(i, 0)
            p = tuple(y for y in p if y[0] != i)
            for to in onward(r, off, reach, strict):
                key = (s, to, p, x or abs(to) > reach)
                total = cost + LOCAL * abs(off) + CARRIED * abs(to)
                if total < closed.get(key, (math.inf,))[0]:
                    closed[key] = (total, chain)
        now = closed
    return {(s, (r, p), x): v for (s, r, p, x), v in now.items()}


def gathered(parts: DataFrame) -> DataFrame:
    """track, chunk, rows: a row for each chunk."""
    rows = F.array_sort(F.collect_list(F.struct("kind", "lo", F.coalesce("event", F.lit(-1)).alias("event"), "opt", "head", "tail", "cost")))
    return parts.groupBy("track", "chunk").agg(rows.alias("rows"))


def table_rows(rows: list[dict]) -> list[tuple]:
    return [tuple(r[f] for f in ("kind", "event", "opt", "head", "tail", "lo", "cost")) for r in rows]


def batch(out: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
    columns = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[ty]) for k, (_, ty) in enumerate(columns)], [n for n, _ in columns])


def carried(now: np.ndarray, off: int, reach: int) -> np.ndarray:
    """Costs by (begin, residual, whether it was beyond the reach) after an interval that is off by `off`; residuals as in `onward`."""
    far = reach + 1
    at = np.arange(-far, far + 1)
    out = np.full_like(now, np.inf)
    to = np.clip(at[1:-1] + off, -far, far)
    plain = np.abs(to) < far
    out[:, to[plain] + far] = now[:, 1:-1][:, plain]
    for side, edge, back in ((1, -1, far + off), (-1, 0, far - off)):
        if (over := to == side * far).any():
            out[:, edge] = np.minimum(out[:, edge], now[:, 1:-1][:, over].min(1))
        reached = at * side >= max(-far, back)  # from beyond, a residual comes back as far as `off` reaches, or stays
        reached[edge] = True
        out[:, reached] = np.minimum(out[:, reached], now[:, edge][:, None])
    for edge in (0, -1):
        out[:, edge, 1] = out[:, edge].min(1)
        out[:, edge, 0] = np.inf
    return out + (CARRIED * np.abs(at))[:, None]


def matrix(rows, reach: int, strict: bool) -> list[tuple]:
    """What `walk` finds, without the ways: (begin, end, whether it was beyond the reach, cost). Pending tails are told apart one by one, begins and residuals are the axes of an array."""
    grid = {int(r[3]): int(r[6]) for r in rows if r[0] == 2}
    own = defaultdict(lambda: defaultdict(list))
    for kind, event, opt, head, tail, lo, cost in rows:
        if kind == 0:
            own[int(lo)][int(event)].append((cost, [int(i) for i in (head, tail) if i >= 0]))
    first = min(grid)
    start = [(0, ())] if first == 0 else begins([r[1:] for r in rows if r[0] == 1], first, reach if strict else reach + 1)
    far = 0 if strict else reach + 1
    now: dict[tuple, np.ndarray] = {}
    least = lambda t, p, x: t.__setitem__(p, np.minimum(t[p], x) if p in t else x)
    for k, (r, p) in enumerate(start):
        if p not in now:
            now[p] = np.full((len(start), 2 * far + 1, 2), np.inf)
        now[p][k, r + far, int(abs(r) > reach)] = 0.0
    for i in sorted(grid):
        for event in sorted(own[i]):
            new = dict(now)
            for p, costs in now.items():
                for c, atoms in own[i][event]:
                    q = plus(p, *atoms)
                    if not strict or all(n <= grid[k] for k, n in q if k in grid):
                        least(new, q, costs + c)
            now = new
        closed: dict[tuple, np.ndarray] = {}
        for p, costs in now.items():
            off = grid[i] - dict(p).get(i, 0)
            if not strict or not off:
                least(closed, tuple(y for y in p if y[0] != i), costs if strict else carried(costs + LOCAL * abs(off), off, reach))
        now = closed
    return [(start[k], (r - far, p), bool(x), costs[k, r, x]) for p, costs in now.items() for k, r, x in np.argwhere(costs < np.inf).tolist()]


def matrices(chunks: DataFrame, reach: int, strict: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for c in b.to_pylist():
                out += [(c["track"], c["chunk"], text(*a), text(*z), x, cost) for a, z, x, cost in matrix(table_rows(c["rows"]), reach, strict)]
                if len(out) > 50_000:
                    yield batch(out, MATRIX)
                    out = []
            yield batch(out, MATRIX)

    return chunks.mapInArrow(run, MATRIX)


def product(level: DataFrame, counts: DataFrame) -> DataFrame:
    """Matrices of pairs of neighbouring nodes; a last node without a neighbour goes up as it is."""
    left = level.where("node % 2 = 0")
    right = level.where("node % 2 = 1").select("track", (F.col("node") - 1).alias("node"), F.col("a").alias("z"), F.col("z").alias("end"), F.col("beyond").alias("too"), F.col("cost").alias("more"))
    met = left.join(right, ["track", "node", "z"]).groupBy("track", (F.col("node") / 2).cast("long").alias("node"), "a", F.col("end").alias("z"), (F.col("beyond") | F.col("too")).alias("beyond")).agg(F.min(F.col("cost") + F.col("more")).alias("cost"))
    lone = left.join(counts, "track").where("node = nodes - 1").select("track", (F.col("node") / 2).cast("long").alias("node"), "a", "z", "beyond", "cost")
    return met.unionByName(lone)


def settled(levels: list[DataFrame], best: DataFrame) -> DataFrame:
    """From the whole track's begin and end down to those of each chunk: track, node, a, z."""
    now = best.select("track", "node", "a", "z")
    for level in reversed([x.where("NOT beyond") for x in levels[:-1]]):
        left = level.where("node % 2 = 0").select("track", (F.col("node") / 2).cast("long").alias("node"), "a", F.col("z").alias("mid"), "cost")
        right = level.where("node % 2 = 1").select("track", ((F.col("node") - 1) / 2).cast("long").alias("node"), F.col("a").alias("mid"), "z", F.col("cost").alias("more"))
        pairs = now.join(left, ["track", "node", "a"]).join(right, ["track", "node", "mid", "z"])
        mid = pairs.groupBy("track", "node", "a", "z").agg(F.min(F.struct(F.round(F.col("cost") + F.col("more"), 6).alias("c"), "mid")).alias("m")).select("track", "node", "a", "z", F.col("m.mid").alias("mid"))
        cut = held(now.join(mid, ["track", "node", "a", "z"], "left"))
        down = cut.where("mid IS NOT NULL").select("track", F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), "a", F.col("mid").alias("z")), F.struct((F.col("node") * 2 + 1).alias("node"), F.col("mid").alias("a"), "z"))).alias("s")).select("track", "s.*")
        now = down.unionByName(cut.where("mid IS NULL").select("track", (F.col("node") * 2).alias("node"), "a", "z"))
    return now


PICK = "track long, event long, opt int"


def picked(chunks: DataFrame, ends: DataFrame, reach: int, strict: bool) -> DataFrame:
    """track, event, opt of the chosen options, chunk by chunk between settled states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for c in b.to_pylist():
                a, z = state(c["a"]), state(c["z"])
                chain = walk(table_rows(c["rows"]), reach, strict, [a])[a, z, False][1]
                while chain:
                    chain, event, opt = chain
                    out.append((c["track"], event, opt))
            yield batch(out, PICK)

    return chunks.join(apart(ends.withColumnRenamed("node", "chunk")), ["track", "chunk"]).mapInArrow(run, PICK)


def fit(options: DataFrame, intervals: DataFrame, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The chosen options (columns of `options`), and track, cost, strict of every track with intervals. At most one option an event is chosen, so that the sum of their costs, LOCAL for
    each unit that an interval is off and CARRIED for each unit that the count is off after it, is least.

    A track's intervals are numbered from 0 without gaps."""
    options, intervals = held(options), held(intervals)
    cheapest = options.groupBy("track", "event", "head", "tail").agg(F.min(F.struct("cost", "opt")).alias("m")).select("track", "event", "head", "tail", "m.cost", "m.opt")  # of options that count alike
    parts = held(gathered(chunked(cheapest, intervals, size)))
    nodes = intervals.groupBy("track").agg((F.floor(F.max("interval") / size) + 1).alias("nodes"))
    left, chosen, costs, reach, strict = held(nodes), [], [], 0, True
    while not left.isEmpty():
        mine = parts.join(left.select("track"), "track", "left_semi")
        levels, counts = [held(matrices(mine, reach, strict))], left
        for _ in range(max(0, math.ceil(math.log2(left.agg(F.max("nodes")).first()[0])))):
            levels.append(held(product(levels[-1], counts)))
            counts = counts.withColumn("nodes", F.ceil(F.col("nodes") / 2))
        whole = levels[-1].where(F.col("z").endswith("|"))
        bound = whole.where("beyond").groupBy("track").agg(F.min("cost").alias("bound"))
        best = whole.where("NOT beyond").groupBy("track").agg(F.min(F.struct(F.round("cost", 6).alias("c"), "z", "node", "a")).alias("m")).select("track", "m.z", "m.node", "m.a", F.col("m.c").alias("cost"))
        proven = held(best.join(bound, "track", "left").where(F.col("bound").isNull() | (F.col("cost") <= F.col("bound") + 1e-6)))
        chosen.append(held(picked(mine.join(proven.select("track"), "track", "left_semi"), settled(levels, proven), reach, strict)))
        costs.append(proven.select("track", "cost", F.lit(strict).alias("strict")))
        left = held(left.join(proven.select("track"), "track", "left_anti"))
        reach, strict = max(1, 2 * reach), False
    none = options.select("track", "event", "opt").limit(0)
    picks = none
    for c in chosen:
        picks = picks.union(c)
    out = intervals.select("track", F.lit(0.0).alias("cost"), F.lit(True).alias("strict")).limit(0)
    for c in costs:
        out = out.union(c)
    return options.join(picks, ["track", "event", "opt"], "left_semi"), out


def cumulative(chosen: DataFrame, intervals: DataFrame) -> DataFrame:
    """track, interval, expected, got, carried: increments of the counter and of the chosen events, and how far the count is off after each interval."""
    atoms = chosen.select("track", F.explode(F.filter(F.array("head", "tail"), lambda i: i >= 0)).alias("interval")).groupBy("track", "interval").agg(F.count("*").alias("got"))
    w = Window.partitionBy("track").orderBy("interval").rowsBetween(Window.unboundedPreceding, 0)
    both = intervals.join(atoms, ["track", "interval"], "left").withColumn("got", F.coalesce("got", F.lit(0)).cast("long"))
    return both.select("track", "interval", F.col("expected").cast("long").alias("expected"), "got", F.sum(F.col("expected") - F.col("got")).over(w).cast("long").alias("carried"))
