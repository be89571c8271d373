"""N-gram Jaccard self-join by grouped prefix filtering, and the components of its links.

A document is the set of its distinct word shingles, as 64-bit hashes. Sets are put in one global order, rare shingles first:
those that are common (a list of bounded size, counted over all documents) come last by count. Two sets of similarity t share one of their first
n - ceil(t n) + 1 shingles. Documents with the same set are one member; members with the same prefix and size are one group.

Groups that share a prefix shingle and pass the size and position filters are candidates. Pairs are never emitted: the task that holds a
shingle's list emits a star for each set of groups that its candidate pairs connect, so a list of n groups costs n rows at most. Every link lies in one
component of these stars. The groups of a component are expanded to members, whose whole sets meet in one task; pairs inside a component of links
found so far need no verification, so n near copies take about n of them.

A component whose sets exceed `BLOCK` bytes is dealt over blocks by hash: members meet in their blocks, representatives of what a block has joined meet in
blocks of their own until that joins no more, and what is then outside the largest class of the component meets every block. So no link is lost and no
task holds more than some blocks."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_VALUE, LOWER, Stage, Texts, components, filter_bits, gather_ranges, id_text, in_filter, input_bytes, power_of_two, range_hashes, splitmix, text_slices, trim, twice_seen, word_bounds

WIDTH = 5
PERCENT = 75
MOST_COMMON = 1 << 16  # length of the list of common shingles; only their order depends on it
COMMON_FROM = 64
BLOCK = 8 << 20  # bytes of shingle sets that one task compares with each other
SLOT = 48 << 20  # bytes of postings and of the sets they name that one task looks at
HOT = 20_000  # shingles of more documents make one candidate component of their whole list, without a look at its pairs
MIX = splitmix(np.arange(64) + 0xABCD) | np.uint64(1)


def shingle_sets(t: Texts, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: of every `width` words, or of all words where there are fewer."""
    s, e, n = word_bounds(t)
    word = range_hashes(BYTE_VALUE[LOWER[t.buf]], s, e)
    full = np.zeros(max(len(word) - width + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            full += splitmix(word[k : k + len(full)] + MIX[k])
        full = splitmix(full)
    out, at = [], 0
    for k in n.tolist():
        if k >= width:
            out.append(np.unique(full[at : at + k - width + 1]))
        elif k:
            out.append(np.array([int.from_bytes(hashlib.blake2b(word[at : at + k].tobytes(), digest_size=8).digest(), "little")], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += k
    return out


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def scattered(prefix: np.ndarray) -> np.ndarray:
    """Names of shingles whose top bits are even. A prefix has the lowest hashes of its set, some quarter of their range, so hashes themselves would leave most slots empty and
    the others four times as full."""
    return splitmix(prefix)


class Order:
    """The global order: shingles that are not common by hash, then common ones from the least common."""

    def __init__(self, common: list[tuple[int, int]], hot: int = HOT):
        rank = sorted((c, h) for h, c in common)
        h = np.array([x[1] for x in rank], np.int64).view(np.uint64)
        by = np.argsort(h)
        self.hashes, self.ranks = h[by], np.arange(len(h))[by]
        self.hot = np.sort(scattered(np.array([h for h, c in common if c > hot], np.int64).view(np.uint64)))

    def prefix(self, s: np.ndarray, percent: int) -> np.ndarray:
        """The first shingles of a sorted set, in the global order."""
        p = prefix_length(len(s), percent)
        if not len(self.hashes):
            return s[:p]
        at = np.minimum(np.searchsorted(self.hashes, s), len(self.hashes) - 1)
        common = self.hashes[at] == s
        rare = s[~common]
        if len(rare) >= p:
            return rare[:p]
        c = s[common][np.argsort(self.ranks[at[common]])]
        return np.concatenate([rare, c[: p - len(rare)]])


def common_shingles(base: DataFrame, width: int) -> list[tuple[int, int]]:
    """The most common shingles with their document counts, over all documents. Every run of some thousand documents drops what it has seen once or twice, so
    a count may fall short by two for each run (lossy counting)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held):
            h, n = np.unique(np.concatenate(held), return_counts=True)
            some = n > 2
            return pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(n[some])], ["h", "n"])

        held, k = [], 0
        for t in text_slices(batches):
            held += (sets := shingle_sets(t, width))
            k += sum(map(len, sets))
            if k > 3_000_000:
                yield flush(held)
                held, k = [], 0
        if held:
            yield flush(held)

    found = base.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_FROM)
    return [(r.h, r.n) for r in found.orderBy(F.desc("n"), "h").limit(MOST_COMMON).collect()]


def _pair(x: bytes) -> tuple[int, int]:
    return int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True)


def digest(a: np.ndarray) -> tuple[int, int]:
    return _pair(hashlib.blake2b(a.tobytes(), digest_size=16).digest())


#: A shingle of a prefix: its hash and its place in the prefix; and the same with the number of its set among those sent along.
PLACED = np.dtype([("token", "<u8"), ("place", "<i4")])
POSTED = np.dtype([("token", "<u8"), ("own", "<i4"), ("place", "<i4")])


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of a set's hashes over some 1 to 2 bits a member, 16,384 bits at most. Two sketches differ in no more bits than their sets in
    members, so a pair whose sketches differ too much does not link."""
    words = power_of_two(len(s) / 64, 1, 256)
    n = np.bincount((s & np.uint64(words * 64 - 1)).astype(np.int64), minlength=words * 64)
    return np.packbits((n & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def binary_parts(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column back to back, and the length of each value; no object a value."""
    off = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int32)
    data = np.frombuffer(a.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, np.diff(off).astype(np.int64)


class Sketches:
    """Sketches of sets; the bits by which pairs differ."""

    def __init__(self, blobs: pa.Array | list[bytes]):
        data, size = binary_parts(pa.array(blobs, pa.binary()))
        flat, self.words = data.view(np.uint64), size >> 3
        first = np.cumsum(self.words) - self.words
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in np.unique(self.words[self.words > 0]).tolist():  # of every length, and folded to half of it
            has = np.flatnonzero(self.words == w)
            rows = flat[first[has][:, None] + np.arange(w)]
            self._put(w, has, rows)
            if w > 1:
                self._put(w // 2, has, rows[:, : w // 2] ^ rows[:, w // 2 :])

    def _put(self, w: int, has: np.ndarray, rows: np.ndarray) -> None:
        place, all_ = self.at.get(w, (np.full(len(self.words), -1), np.zeros((0, w), np.uint64)))
        place[has] = len(all_) + np.arange(len(has))
        self.at[w] = place, np.concatenate([all_, rows])

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bits by which the sketches of x[i] and y[i] differ; 0 where that is not known."""
        out = np.zeros(len(x), np.int64)
        low = np.minimum(self.words[x], self.words[y])
        for w in np.unique(low[low > 0]).tolist():
            place, rows = self.at[w]
            at = np.flatnonzero((low == w) & (place[x] >= 0) & (place[y] >= 0))
            for i in range(0, len(at), max(1, (1 << 20) // w)):
                k = at[i : i + max(1, (1 << 20) // w)]
                out[k] = np.bitwise_count(rows[place[x[k]]] ^ rows[place[y[k]]]).sum(axis=1)
        return out


def pack_postings(slots: int, order):
    """(gid, n, prefix, sketch) rows to (slot, postings, the sets they name), packed by the top bits of the shingle. Hot shingles are left out."""
    shift = np.uint64(64 - (slots.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            got = [np.frombuffer(x.as_buffer(), PLACED) for x in b.column(2)]
            got = [g[~np.isin(g["token"], order.value.hot)] for g in got] if len(order.value.hot) else got
            x = np.concatenate(got)
            rows = np.empty(len(x), POSTED)
            rows["token"], rows["place"] = x["token"], x["place"]
            rows["own"] = np.repeat(np.arange(len(got)), [len(g) for g in got])
            slot = (rows["token"] >> shift).astype(np.int64) if slots > 1 else np.zeros(len(rows), np.int64)
            by = np.argsort(slot, kind="stable")
            rows, slot = rows[by], slot[by]
            if not len(rows):
                continue
            cut = np.append(np.flatnonzero(np.diff(slot, prepend=-1)), len(slot))
            out = []
            for i, j in zip(cut, cut[1:]):
                part = rows[i:j].copy()
                sent, part["own"] = np.unique(part["own"], return_inverse=True)
                out.append((int(slot[i]), part.tobytes(), b.select([0, 1, 3]).take(pa.array(sent)).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary()), pa.array([[(r["gid"], r["n"], r["sketch"]) for r in o[2]] for o in out], pa.list_(pa.struct([("gid", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])))], ["slot", "rows", "sets"])

    return run


PACKED = "slot int, rows binary, sets array<struct<gid:bigint,n:bigint,sketch:binary>>"


def slots_for(sets: int, postings: float, sketched: float) -> int:
    """Slots, so that one has no more than SLOT bytes of postings and of the sets they name: a set with some `postings` and bytes of a sketch goes once to each slot that has one of them."""
    slots = 32
    while slots < 1 << 20 and sets * (postings * POSTED.itemsize / slots + (1 - (1 - 1 / slots) ** postings) * (16 + sketched)) > SLOT:
        slots *= 2
    return slots


def merge_labels(lab: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels after joining x[i] with y[i]: each class takes its smallest index."""
    while True:
        low = np.minimum(lab[x], lab[y])
        was = lab.copy()
        np.minimum.at(lab, lab[x], low)
        np.minimum.at(lab, lab[y], low)
        while (nxt := lab[lab] != lab).any():
            lab[nxt] = lab[lab[nxt]]
        if (lab == was).all():
            return lab


def candidate_stars(token: np.ndarray, place: np.ndarray, own: np.ndarray, n_of: np.ndarray, sketches: Sketches, percent: int) -> np.ndarray:
    """Labels of sets after joining the candidate pairs of all lists: own[i] is the set of the shingle token[i], at place[i] of its prefix.

    A pair of a list is a candidate if sizes allow a link, if what follows the shingle in both sets can hold the shared part, and if the sketches
    don't differ by more than linked sets do. A linked pair is a candidate in the list of the first shingle that it shares."""
    n = n_of[own]
    by = np.lexsort((n, token))
    token, place, own, n = token[by], place[by], own[by], n[by]
    top = (n - place) * (100 + percent) // percent - n  # the largest partner that the rest of the set allows
    most = np.minimum(n * 100 // percent, top)  # sizes go up along a list
    start = np.flatnonzero(np.diff(token, prepend=~token[:1]))
    size = np.diff(np.append(start, len(token)))
    lab = np.arange(len(n_of))
    end = np.repeat(start + size, size)

    def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return sketches.differ(x, y) * (100 + percent) <= (n_of[x] + n_of[y]) * (100 - percent)

    short = np.flatnonzero(np.repeat((size > 1) & (size <= 64), size))
    for step in range(1, 64):  # short lists: pairs of all lists at once, so far apart
        short = short[short + step < end[short]]
        if not len(short):
            break
        ok = short[(n[short + step] <= most[short]) & (n[short] <= top[short + step])]
        x, y = own[ok], own[ok + step]
        other = lab[x] != lab[y]
        x, y = x[other], y[other]
        ok = alike(x, y)
        lab = merge_labels(lab, x[ok], y[ok])
    for s, k in zip(start[size > 64].tolist(), size[size > 64].tolist()):
        o, nn, tt = own[s : s + k], n[s : s + k], top[s : s + k]
        until = np.searchsorted(nn, most[s : s + k], side="right")
        for i in range(k - 1):
            if not i % 64 and (lab[o[i:]] == lab[o[i]]).all():
                break
            j = np.arange(i + 1, max(until[i], i + 1))
            j = o[j[(nn[i] <= tt[j]) & (lab[o[j]] != lab[o[i]])]]
            j = j[alike(np.full(len(j), o[i]), j)]
            if len(j):
                seen = np.unique(np.append(lab[j], lab[o[i]]))
                lab[np.isin(lab, seen)] = seen[0]
    return lab


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def join_sets(sets: list[np.ndarray], lab: np.ndarray, percent: int, probe: np.ndarray | None = None) -> np.ndarray:
    """Labels after joining the classes of all sets that link; with `probe`, only links between a probe and another set are looked for.

    Sets come in order of size; each is compared with the smaller ones that share enough of its prefix, as long as they are of another class. Prefixes
    are of the order by counts among these sets, rare ones first."""
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    by = np.argsort(n, kind="stable")
    at = np.empty(m, np.int64)
    at[by] = np.arange(m)
    _, rank, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(count), np.int64)
    place[np.argsort(count, kind="stable")] = np.arange(len(count))
    cuts = np.append(0, np.cumsum(n))
    pre = [np.sort(place[rank[cuts[i] : cuts[i + 1]]])[: prefix_length(int(n[i]), percent)] for i in range(m)]
    own = np.repeat(np.arange(m), [len(p) for p in pre])
    tok = np.concatenate(pre)
    del rank, place
    o = np.lexsort((at[own], tok))
    tok, own = tok[o], own[o]
    first = np.flatnonzero(np.diff(tok, prepend=~tok[:1]))
    size = np.diff(np.append(first, len(tok)))
    lists, start = np.repeat(np.arange(len(first)), size), np.repeat(first, size)
    mine = np.argsort(own, kind="stable")  # places in lists, by set
    mine = mine[np.repeat(size > 1, size)[mine]]
    cut = np.searchsorted(own[mine], np.arange(m + 1))
    beyond = -(-percent * n // 100) - 1  # shingles after a prefix
    whole, one = np.ones(len(first), bool), own[first]  # lists whose sets so far are of one class, and one of them
    lab = lab.copy()

    def join(x: int, y: int) -> None:
        a, b = lab[x], lab[y]
        lab[lab == max(a, b)] = min(a, b)

    for x in by.tolist():
        e = mine[cut[x] : cut[x + 1]]
        e = e[e > start[e]]
        if not len(e):
            continue
        before = np.bincount(own[e - 1], minlength=1)
        y = int(before.argmax())  # the set that most often precedes this one
        if lab[y] != lab[x] and (probe is None or probe[x] != probe[y]) and n[y] * 100 >= n[x] * percent and linked(sets[x], sets[y], percent):
            join(x, y)
        l = lists[e]
        other = e[~(whole[l] & (lab[one[l]] == lab[x]))]
        if len(other):
            c = own[gather_ranges(start[other], other - start[other])]
            c = c[(lab[c] != lab[x]) & (n[c] * 100 >= n[x] * percent)]
            if probe is not None:
                c = c[probe[c] != probe[x]]
            if len(c):
                c, shared = np.unique(c, return_counts=True)
                # with o shingles in both prefixes, two sets share at most o and what follows the prefix that ends first
                ok = (shared + np.maximum(beyond[c], beyond[x])) * (100 + percent) >= (n[c] + n[x]) * percent
                c = c[ok][np.argsort(-shared[ok], kind="stable")]
                while len(c):
                    if linked(sets[x], sets[c[0]], percent):
                        join(x, int(c[0]))
                        c = c[lab[c] != lab[x]]
                    else:
                        c = c[1:]
        whole[l] &= lab[one[l]] == lab[x]
    return lab


def link_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Null and empty texts have no shingles and link with nothing; their component is their own doc_id. Rows with one doc_id are one document: they share a component. A
    row without doc_id takes part by its text and gets the component of its set (null if no row with a doc_id has it). Texts of any length are read
    whole; an empty table gives no rows; further columns are not read. Shingles and sets are told apart by 64-bit and 128-bit hashes."""
    base = id_text(docs, id_col, text_col)
    spark = docs.sparkSession
    stage = Stage(spark, "jaccard")
    size = input_bytes(base)
    order = spark.sparkContext.broadcast(Order(common_shingles(base, width), hot))

    def prefixes(batches):
        for t in text_slices(batches):
            yield scattered(np.concatenate([order.value.prefix(s, percent) for s in shingle_sets(t, width) if len(s)] or [np.zeros(0, np.uint64)]))

    bits = spark.sparkContext.broadcast(twice_seen(base, prefixes, size / 4, filter_bits(size / 64, 26)))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text_slices(batches):
            rows = []
            for s in shingle_sets(t, width):
                p = order.value.prefix(s, percent) if len(s) else s
                token = scattered(p)
                place = np.flatnonzero(in_filter(bits.value, token))
                some = np.empty(len(place), PLACED)
                some["token"], some["place"] = token[place], place
                rows.append((len(s), *digest(s), *digest(p), some.tobytes() if len(some) else None, sketch(s).tobytes() if len(some) else None))
            yield pa.RecordBatch.from_arrays([t.id_array(), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(5)), *(pa.array([r[k] for r in rows], pa.binary()) for k in (5, 6))], ["doc_id", "n", "s1", "s2", "p1", "p2", "prefix", "sketch"])

    known = stage.write(base.mapInArrow(describe, "doc_id long, n long, s1 long, s2 long, p1 long, p2 long, prefix binary, sketch binary"), "known")
    members = stage.write(known.where("n > 0").groupBy("s1", "s2", "n", "p1", "p2").agg(F.min("doc_id").alias("node"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch")), "members")
    groups = members.where("node IS NOT NULL").groupBy("p1", "p2", "n").agg(F.min("node").alias("gid"), F.count("*").alias("k"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"))
    # a group of several sets is compared by size and place only
    groups = stage.write(groups.withColumn("sketch", F.when(F.col("k") == 1, F.col("sketch")).otherwise(F.lit(b""))), "groups")
    post = groups.where("prefix IS NOT NULL").select("gid", "n", "prefix", "sketch")
    stage.release()

    def stars(key, table):
        sets = table.column("sets").combine_chunks()
        data, length = binary_parts(table.column("rows").combine_chunks())
        rows = data.view(POSTED)
        own = rows["own"] + np.repeat(np.asarray(sets.offsets)[:-1] - np.asarray(sets.offsets)[0], length // POSTED.itemsize)
        flat = sets.flatten()
        ids, one, of = np.unique(np.asarray(flat.field("gid")), return_index=True, return_inverse=True)
        n, sketches = np.asarray(flat.field("n"))[one], Sketches(flat.field("sketch").take(pa.array(one)))
        token, place, own = rows["token"].copy(), rows["place"].astype(np.int64), of[own]
        del table, sets, flat, data, rows, of, one
        lab = candidate_stars(token, place, own, n, sketches, percent)
        trim()
        moved = np.flatnonzero(lab != np.arange(len(lab)))
        return pa.table({"a": pa.array(ids[moved], pa.int64()), "b": pa.array(ids[lab[moved]], pa.int64())})

    def hot_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, p in zip(b.column(0).to_pylist(), b.column(2)):
                t = np.frombuffer(p.as_buffer(), PLACED)["token"]
                t = t[np.isin(t, order.value.hot)].view(np.int64)
                if len(t):  # the shingle itself is the star's centre
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), g), pa.int64()), pa.array(t)], ["a", "b"])

    per = post.agg(F.count("*"), F.avg(F.octet_length("prefix")), F.avg(F.octet_length("sketch"))).first()
    slots = slots_for(per[0], (per[1] or 0) / PLACED.itemsize, per[2] or 0)
    edges = post.mapInArrow(pack_postings(slots, order), PACKED).groupBy("slot").applyInArrow(stars, "a long, b long").union(post.mapInArrow(hot_stars, "a long, b long"))
    near = components(stage.write(edges, "stars"), stage, "near")
    # groups with candidates, and groups of several members
    met = near.select(F.col("node").alias("gid"), F.col("comp").alias("cc")).union(near.select(F.col("comp").alias("gid"), F.col("comp").alias("cc")).distinct())
    wanted = groups.join(met, "gid", "left").where("cc IS NOT NULL OR k > 1").select("p1", "p2", "n", F.coalesce("cc", "gid").alias("cc"))
    nodes = stage.write(members.where("node IS NOT NULL").join(wanted, ["p1", "p2", "n"]).select("node", "s1", "s2", "cc"), "nodes")
    comp = stage.write(classes(base, nodes, stage, width, percent, block, size), "classes")
    stage.release()
    out = known.drop("prefix").join(members.select("s1", "s2", "n", "node"), ["s1", "s2", "n"], "left").join(comp, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("label", "node")).otherwise(F.col("doc_id")).alias("component_id"))


def classes(base: DataFrame, nodes: DataFrame, stage: Stage, width: int, percent: int, block: int, size: int) -> DataFrame:
    """node, label: the smallest node that is reachable by links, for all of `nodes` (node, s1, s2, cc). Links lie within one cc."""
    spark = base.sparkSession

    def names(batches):
        for b in batches:
            h = splitmix(np.asarray(b.column(0)).astype(np.int64).view(np.uint64))
            yield np.concatenate([h, h])

    wanted = spark.sparkContext.broadcast(twice_seen(nodes.select("node"), names, size / 100))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.asarray(b.column(0).fill_null(0)).astype(np.int64)
            here = pa.array(in_filter(wanted.value, splitmix(ids.view(np.uint64))) & np.asarray(b.column(0).is_valid()))
            for t in text_slices([b.filter(here)]):
                rows = [(*digest(s), s.tobytes()) for s in shingle_sets(t, width)]
                yield pa.RecordBatch.from_arrays([t.id_array(), *(pa.array([r[k] for r in rows], ty) for k, ty in enumerate((pa.int64(), pa.int64(), pa.binary())))], ["node", "s1", "s2", "shingles"])

    made = base.mapInArrow(emit, "node long, s1 long, s2 long, shingles binary").groupBy("node", "s1", "s2").agg(F.first("shingles").alias("shingles"))
    sets = stage.write(made.join(nodes, ["node", "s1", "s2"]).select("node", "cc", "shingles"), "sets")
    total = sets.agg(F.coalesce(F.sum(F.octet_length("shingles")), F.lit(0))).first()[0]
    buckets = power_of_two(4 * total / block, 32, 1 << 20)

    def joined(df: DataFrame, alone: bool = False) -> DataFrame:
        """node, label after joining what links among the rows (node, label, probe, shingles) of each key. Several keys go to a task's memory at once, for most have few
        rows; `alone`: one at a time."""

        def run(key, table):
            out, labels = [], []
            keys, own = np.unique(np.asarray(table.column("key")), return_inverse=True)
            node, was = np.asarray(table.column("node")), np.asarray(table.column("label"))
            flag, data = np.asarray(table.column("probe")), table.column("shingles").combine_chunks()
            by = np.argsort(own, kind="stable")
            for rows in np.split(by, np.flatnonzero(np.diff(own[by])) + 1):
                ids, lab = np.unique(was[rows], return_inverse=True)
                if len(rows) > 1:
                    lab = join_sets([np.frombuffer(data[int(i)].as_buffer(), np.uint64) for i in rows], lab, percent, flag[rows] > 0 if (flag[rows] >= 0).any() else None)
                out.append(node[rows])
                labels.append(ids[lab])
            return pa.table({"node": pa.array(np.concatenate(out), pa.int64()), "label": pa.array(np.concatenate(labels), pa.int64())})

        dealt = df.withColumn("bucket", F.col("key") if alone else F.pmod("key", F.lit(buckets)))
        return dealt.groupBy("bucket").applyInArrow(run, "node long, label long")

    def blocks(df: DataFrame) -> DataFrame:
        """How many blocks the components need that are too large for one."""
        return df.groupBy("cc").agg(F.ceil(F.sum(F.octet_length("shingles")) / block).alias("blocks")).where("blocks > 1")

    def dealt(df: DataFrame, many: DataFrame) -> DataFrame:
        return df.join(many, "cc", "left").withColumn("part", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1)))).withColumn("key", F.xxhash64("cc", "part"))

    many = stage.write(blocks(sets), "many")
    own = dealt(sets, many).select("key", "node", F.col("node").alias("label"), F.lit(-1).alias("probe"), "shingles")
    labels = stage.write(joined(own), "labels-0")
    if many.isEmpty():
        return labels
    large = stage.write(sets.join(many.select("cc"), "cc", "left_semi"), "large")
    last, k = None, 0
    while True:  # representatives of what blocks have joined
        reps = large.join(labels.where("node = label"), "node")
        now = reps.count()
        if last is not None and now * 2 > last:
            break
        last, k = now, k + 1
        new = joined(dealt(reps.select("node", "cc", "shingles"), blocks(reps)).select("key", "node", F.col("node").alias("label"), F.lit(-1).alias("probe"), "shingles"))
        new = new.select(F.col("node").alias("label"), F.col("label").alias("to"))
        labels = stage.write(labels.join(new, "label", "left").select("node", F.coalesce("to", "label").alias("label")), f"labels-{k}")
    # what lies outside the largest class of its component meets every block
    named = large.join(labels, "node")
    sizes = named.groupBy("cc", "label").agg(F.sum(F.octet_length("shingles")).alias("bytes"))
    most = sizes.groupBy("cc").agg(F.max_by("label", F.struct("bytes", "label")).alias("most"), F.sum("bytes").alias("all"), F.max("bytes").alias("top"))
    most = most.where("top < all").select("cc", "most", F.ceil((F.col("all") - F.col("top")) / block).cast("int").alias("probes"), F.ceil(F.col("all") / block).cast("int").alias("blocks"))
    named = named.join(most, "cc").withColumn("hash", F.xxhash64("node"))
    sides = F.sequence(F.lit(0), F.col("probes") - 1), F.sequence(F.lit(0), F.col("blocks") - 1)
    build = named.select("cc", "node", "label", "shingles", F.lit(0).alias("probe"), F.pmod("hash", "blocks").cast("int").alias("i"), F.explode(sides[0]).alias("j"))
    probe = named.where("label <> most").select("cc", "node", "label", "shingles", F.lit(1).alias("probe"), F.explode(sides[1]).alias("i"), F.pmod(F.xxhash64("hash"), "probes").cast("int").alias("j"))
    met = joined(build.union(probe).select(F.xxhash64("cc", "i", "j").alias("key"), "node", "label", "probe", "shingles"), alone=True)  # keys grow with the square of a component, buckets don't
    # classes joined here or there: stars over the labels so far
    edges = met.join(labels.withColumnRenamed("label", "was"), "node").select(F.col("was").alias("a"), F.col("label").alias("b")).where("a <> b").distinct()
    ends = components(stage.write(edges, "edges"), stage, "ends").select(F.col("node").alias("label"), F.col("comp").alias("to"))
    return labels.join(ends, "label", "left").select("node", F.coalesce("to", "label").alias("label"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
