"""LM scoring with Brown's class-based bigram model.

P(w | v) = P(class w | class v) * P(w | class w). Exchange clustering assigns every word of the training part to a class. The CORE most frequent words find
classes among themselves, one after the other. Then all words take exchange steps over all bigrams: the HEAD most frequent in PARTS, the words of a part at once
and taken back where that lowers the likelihood; then all rarer words, however many there are, each by its own neighbours; and the HEAD again, with the rarer words'
classes known, sweep by sweep until the likelihood stops rising. Words never seen in training take the class most common among training words with their last three bytes. Transitions are smoothed
towards the classes' frequencies, emissions by adding one, with one unseen word a class.

Words are told apart by a 64-bit hash of their lower-case bytes. Texts are written once as codes: a HEAD word is a number that all executors know, a rarer
word a place in its text's list of hashes, whose classes a join brings to the text. So a step is one pass over codes that sends counts of (word, class of a neighbour) of one part of the words. Vocabulary, rare words'
neighbours and classes grow with the corpus and stay distributed; HEAD's counts and the tables between classes have a fixed size."""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_VALUE, LOWER, Stage, Texts, binary_array, id_text, input_bytes, power_of_two, range_hashes, splitmix, text_slices, trim, word_bounds

CORE, HEAD, BUCKETS, CLASSES, SWEEPS = 2048, 1 << 17, 1024, 48, 4
PARTS, MOST_SWEEPS = 4, 12  # parts: a power of two
RISE = 5e-3  # sweeps end where one raises the likelihood by less than this part
SMOOTH = 20.0
END = 0  # id and code of the end of a text
FIRST_RARE = 1 << 17  # codes from here on are places in a text's list of rare words
OWN = 2 * CLASSES  # slots of a word's neighbours: classes before it, classes after it, itself
SLOTS = OWN + 1
RARE = np.dtype([("id", "<i8"), ("bucket", "<u2")])
KNOWN = np.dtype([("n", "<i8"), ("c", "u1")])  # of a rare word: its count and class; count 0 if never seen in training
TOKENS = 1 << 20  # tokens that are handled at once


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def hashed(t: Texts) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray], np.ndarray]:
    """Hashes of the words of all texts, back to back, the suffix buckets of those that are asked for, and how many words each text has."""
    s, e, n = word_bounds(t)
    low = LOWER[t.buf]
    ids = range_hashes(BYTE_VALUE[low], s, e)
    ids[ids == END] = 1

    def buckets(at: np.ndarray) -> np.ndarray:
        end, size = e[at], e[at] - s[at]
        last = np.zeros(len(at), np.uint64)
        for k in range(3):
            has = size > k
            last[has] |= low[end[has] - 1 - k].astype(np.uint64) << np.uint64(8 * k)
        return (splitmix(last) % np.uint64(BUCKETS)).astype(np.uint16)

    return ids, buckets, n


def count_words(train: DataFrame) -> DataFrame:
    """id, n, bucket over all training tokens; the end of a text has the id END."""
    slots = power_of_two(input_bytes(train) / (8 << 20), 16, 1 << 16)
    shift = np.uint64(64 - (slots.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            every = np.concatenate([np.zeros(ends, np.uint64), *(h[0] for h in held)])
            by = np.argsort(every)
            every = every[by]
            cut = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
            ids, some, n = every[cut], by[cut], np.diff(cut, append=len(every))
            of, at = np.zeros(len(ids), np.uint16), ends
            for words, buckets in held:
                here = np.flatnonzero((some >= at) & (some < at + len(words)))
                of[here] = buckets(some[here] - at)
                at += len(words)
            slot = (ids >> shift).astype(np.int64)
            cut = np.append(np.flatnonzero(np.diff(slot, prepend=-1)), len(slot))
            return pa.RecordBatch.from_arrays([pa.array(slot[cut[:-1]].astype(np.int32)), *(binary_array(np.ascontiguousarray(x), (cut - cut[0]) * x.itemsize) for x in (ids, n.astype(np.uint32), of))], ["slot", "ids", "n", "buckets"])

        held, ends, k = [], 0, 0
        for t in text_slices(batches):
            ids, buckets, n = hashed(t)
            held.append((ids, buckets))
            ends += len(n)
            k += len(ids) + len(n)
            if k > 3_000_000:
                yield flush()
                held, ends, k = [], 0, 0
        if k:
            yield flush()

    def add(key, table):
        ids, n, of = (np.frombuffer(b"".join(table.column(c).to_pylist()), d) for c, d in (("ids", np.uint64), ("n", np.uint32), ("buckets", np.uint16)))
        by = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.append(True, ids[by][1:] != ids[by][:-1]))
        return pa.table({"id": pa.array(ids[by][first].view(np.int64)), "n": pa.array(np.add.reduceat(n[by].astype(np.int64), first)), "bucket": pa.array(of[by][first].astype(np.int32))})

    return train.mapInArrow(run, "slot int, ids binary, n binary, buckets binary").groupBy("slot").applyInArrow(add, "id long, n long, bucket int")


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(grams: np.ndarray, fixed: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of units from their bigram counts. Unit `fixed` (the end) has class 0 to itself; the last unit (all other words) takes part."""
    n = len(grams)
    cls = 1 + np.arange(n) % (classes - 1)
    cls[fixed] = 0
    one = np.eye(classes)[cls]
    table = one.T @ grams @ one
    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            if w == fixed:
                continue
            a, own = cls[w], grams[w, w]
            r = np.bincount(cls, grams[w], classes)
            c = np.bincount(cls, grams[:, w], classes)
            r[a] -= own
            c[a] -= own
            table[a] -= r
            table[:, a] -= c
            table[a, a] -= own
            both = np.diagonal(table)
            gain = (xlogx(table + r) - xlogx(table)).sum(1) + (xlogx(table.T + c) - xlogx(table.T)).sum(1)
            gain += xlogx(both + r + c + own) - xlogx(both) - (xlogx(both + r) - xlogx(both)) - (xlogx(both + c) - xlogx(both))
            rows, cols = table.sum(1), table.sum(0)
            gain -= xlogx(rows + r.sum() + own) - xlogx(rows) + xlogx(cols + c.sum() + own) - xlogx(cols)
            # what w adds to the other classes' margins is the same wherever it goes
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += r
            table[:, b] += c
            table[b, b] += own
            moved += b != a
            cls[w] = b
        if not moved:
            break
    return cls


def likelihood(table: np.ndarray) -> float:
    """The part of the log likelihood that depends on classes."""
    return float(xlogx(table).sum() - xlogx(table.sum(1)).sum() - xlogx(table.sum(0)).sum())


def gains(table: np.ndarray, cls: np.ndarray, before: np.ndarray, after: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Likelihood of each word in each class against without the word, all other words staying. before, after: words x classes, without the word itself."""
    m, all_b = len(cls), np.arange(CLASSES)
    gain = np.zeros((m, CLASSES))
    for near, far, t in ((after, before, table), (before, after, table.T)):
        w, k = np.nonzero(near)
        n, a = near[w, k], cls[w]
        x = t[:, k].T  # counts between each class and k, and below without the word
        x[np.arange(len(w)), a] -= n
        same = np.flatnonzero(k == a)
        x[same] -= far[w[same]]
        x[same, a[same]] -= own[w[same]]
        d = xlogx(x + n[:, None]) - xlogx(x)
        first = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else w
        if len(w):
            gain[w[first]] += np.add.reduceat(d, first)
    both = np.repeat(np.diagonal(table)[None], m, 0)
    i = np.arange(m)
    both[i, cls] -= after[i, cls] + before[i, cls] + own
    s = own[:, None]
    gain += xlogx(both + after + before + s) + xlogx(both) - xlogx(both + after) - xlogx(both + before)
    for near, t in ((after, table.sum(1)), (before, table.sum(0))):
        n = near.sum(1) + own
        x = np.repeat(t[None], m, 0)
        x[i, cls] -= n
        # the other margin of the classes around it is the same wherever the word goes
        gain -= xlogx(x + n[:, None]) - xlogx(x)
    gain[:, all_b == 0] = -np.inf
    return gain


class Head:
    """The most frequent training words: codes by hash (the end has 0), counts and buckets by code. Of fixed size."""

    def __init__(self, words: DataFrame):
        top = words.where(F.col("id") != END).orderBy(F.desc("n"), "id").limit(HEAD - 1).select("id", "n", "bucket").toArrow()
        ends = words.where(F.col("id") == END).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        ids = np.array(top.column("id"), np.int64).view(np.uint64)
        by = np.argsort(ids)
        self.ids, self.code = ids[by], (by + 1).astype(np.int32)
        self.n = np.concatenate([[ends], np.array(top.column("n"), np.int64)]).astype(np.int64)
        self.bucket = np.concatenate([[0], np.array(top.column("bucket"), np.int64)]).astype(np.int64)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        """Codes; -1 for other words."""
        if not len(self.ids):
            return np.full(len(ids), -1, np.int32)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, self.code[at], -1)


def code(docs: DataFrame, head) -> DataFrame:
    """doc_id, z (codes, the end last, low halves before high ones; FIRST_RARE + k for the text's k-th rare word), rare (RARE). docs: doc_id, text; head: a broadcast Head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text_slices(batches):
            ids, buckets, n = hashed(t)
            doc = np.repeat(np.arange(len(t)), n)
            word = head.value(ids).astype(np.int64)
            rare = np.flatnonzero(word < 0)
            by = rare[np.lexsort((ids[rare], doc[rare]))]
            new = np.append(True, (ids[by][1:] != ids[by][:-1]) | (doc[by][1:] != doc[by][:-1]))[: len(by)]
            number = np.cumsum(new) - 1
            kinds = np.bincount(doc[by[new]], minlength=len(t))
            start = np.cumsum(kinds) - kinds
            word[by] = FIRST_RARE + number - start[doc[by]]
            flat = np.zeros(len(ids) + len(t), np.int64)
            flat[np.arange(len(ids)) + doc] = word
            low, high = (flat & 0xFFFF).astype("<u2"), (flat >> 16).astype("<u2")
            listed = np.empty(int(kinds.sum()), RARE)
            listed["id"], listed["bucket"] = ids[by[new]].view(np.int64), buckets(by[new])
            cut, at = np.append(0, np.cumsum(n + 1)).tolist(), np.append(0, np.cumsum(kinds)).tolist()
            zs = [low[i:j].tobytes() + high[i:j].tobytes() for i, j in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([t.id_array(), pa.array(zs, pa.binary()), pa.array([listed[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary())], ["doc_id", "z", "rare"])

    return docs.mapInArrow(run, "doc_id long, z binary, rare binary")


def decoded(z: bytes) -> np.ndarray:
    x = np.frombuffer(z, "<u2").reshape(2, -1)
    return x[0] | x[1].astype(np.int32) << 16


def runs(batches: Iterator[pa.RecordBatch], cls: np.ndarray, other: int, ids: bool = False) -> Iterator[tuple]:
    """Some texts at a time, back to back: codes (-1 for rare words), classes, the same of the token before each; with `ids`, also the rare words' ids (0 for others) and those
    before. Batches have z, rare and known (KNOWN; null: all rare words have the class `other`) first. The token before a text's first is the end."""
    cls = cls.astype(np.uint8)

    def joined(held: list[tuple]) -> tuple:
        flat = np.concatenate([x[0] for x in held])
        size = np.array([len(x[0]) for x in held])
        rare = np.flatnonzero(flat >= FIRST_RARE)
        c = cls[np.where(flat < FIRST_RARE, flat, 0)]
        c[rare] = other
        whose = np.searchsorted(np.cumsum(size), rare, side="right")
        many = np.array([len(x[1]) // RARE.itemsize for x in held])
        at = (np.cumsum(many) - many)[whose] + flat[rare] - FIRST_RARE
        if any(x[2] is not None for x in held):
            c[rare] = np.concatenate([np.full(len(x[1]) // RARE.itemsize, other, np.uint8) if x[2] is None else np.frombuffer(x[2], KNOWN)["c"] for x in held])[at]
        out = [flat, c]
        if ids:
            word = np.zeros(len(flat), np.int64)
            word[rare] = np.frombuffer(b"".join(x[1] for x in held), RARE)["id"][at]
            out.append(word)
        flat[rare] = -1
        return *out, *(previous(x, size, 0) for x in out)

    held, k = [], 0
    for b in batches:
        for z, rare, known in zip(*(b.column(i).to_pylist() for i in range(3))):
            held.append((decoded(z), rare, known))
            k += len(z) // 4
            if k >= TOKENS:
                yield joined(held)
                held, k = [], 0
    if held:
        yield joined(held)
    trim()


def pack(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys and counts, in four bytes each where that will do."""
    x = np.concatenate([np.diff(keys, prepend=0), n])
    small = x.max(initial=0) < 2**32
    return (b"4" if small else b"8") + zlib.compress(x.astype("<u4" if small else "<i8").tobytes(), 1)


def unpack(z: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(zlib.decompress(z[1:]), "<u4" if z[:1] == b"4" else "<i8").astype(np.int64)
    return np.cumsum(x[: len(x) // 2]), x[len(x) // 2 :]


def counted(coded: DataFrame, keys, sizes: tuple[int, ...], blocks: int = 16) -> list[np.ndarray]:
    """Counts of the keys that keys(batches) yields as arrays, one for each of `sizes`, the bounds of the keys. Key spaces are bounded, so a task and the driver may hold
    their counts; those of tasks are added up first, one block of the keys and a part of the tasks at a time."""
    cut = [[n * k // blocks for k in range(blocks + 1)] for n in sizes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums = [np.zeros(n, np.int64) for n in sizes]
        for some in keys(batches):
            for total, k in zip(sums, some):
                total += np.bincount(k, minlength=len(total))
        rows = []
        for i, total in enumerate(sums):
            k = np.flatnonzero(total)
            at = np.searchsorted(k, cut[i])
            rows += [(i * blocks + b, pack(k[x:y], total[k[x:y]])) for b, (x, y) in enumerate(zip(at, at[1:])) if y > x]
        lane = TaskContext.get().partitionId() % 16
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([lane] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "lane", "z"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds up block by block as rows come; a task holds no more than the blocks' bounded sums."""
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for which, z in zip(b.column(0).to_pylist(), b.column(2)):
                i, j = divmod(which, blocks)
                total = sums.setdefault(which, np.zeros(cut[i][j + 1] - cut[i][j], np.int64))
                k, n = unpack(z.as_py())
                total[k - cut[i][j]] += n
        rows = []
        for which, total in sums.items():
            k = np.flatnonzero(total)
            rows.append((which, pack(k + cut[which // blocks][which % blocks], total[k])))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "z"])

    parts = coded.mapInArrow(run, "block int, lane int, z binary").repartition("block", "lane").mapInArrow(add, "block int, z binary")
    out = [np.zeros(n) for n in sizes]
    for r in parts.collect():
        k, n = unpack(r.z)
        out[r.block // blocks][k] += n
    return out


def core_bigrams(coded: DataFrame, size: int) -> np.ndarray:
    """Bigram counts of the codes below `size`; all other words are the last unit."""

    def keys(batches):
        for flat, _, before, _ in runs(batches, np.zeros(FIRST_RARE, np.uint8), 0):
            a, b = (np.where((x < 0) | (x >= size), size, x).astype(np.int64) for x in (before, flat))
            yield (a * (size + 1) + b,)

    return counted(coded, keys, ((size + 1) ** 2,))[0].reshape(size + 1, size + 1)


def neighbours(coded: DataFrame, cls: np.ndarray, other: int, part: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The table between classes; and for the codes part, part + PARTS, ... how often each slot is at them."""
    given = coded.sparkSession.sparkContext.broadcast(cls)

    def keys(batches):
        for flat, c, before, c0 in runs(batches, given.value, other):
            pairs = c0.astype(np.int32) * CLASSES + c
            if part is None:
                yield (pairs,)
            else:
                own = (flat == before) & (flat > 0)
                b = np.flatnonzero((flat > 0) & (flat & (PARTS - 1) == part))
                a = np.flatnonzero((before > 0) & (before & (PARTS - 1) == part) & ~own)
                yield pairs, np.concatenate([flat[b] // PARTS * SLOTS + np.where(own[b], OWN, c0[b]), before[a] // PARTS * SLOTS + CLASSES + c[a]])

    words = len(cls) // PARTS + 1
    got = counted(coded, keys, (CLASSES * CLASSES,) if part is None else (CLASSES * CLASSES, words * SLOTS))
    given.unpersist()
    return got[0].reshape(CLASSES, CLASSES), got[1].reshape(-1, SLOTS) if part is not None else np.zeros((0, SLOTS))


def better(table: np.ndarray, cls: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The class of each word that raises the likelihood most, all other words staying; its own if none does. x: words x SLOTS."""
    out = cls.copy()
    for i in range(0, len(cls), 1024):
        j = slice(i, i + 1024)
        g = gains(table, cls[j], x[j, :CLASSES], x[j, CLASSES:OWN], x[j, OWN])
        best, k = np.argmax(g, 1), np.arange(len(cls[j]))
        out[j] = np.where((g[k, best] > g[k, cls[j]] + 1e-9) & (x[j].sum(1) > 0), best, cls[j])
    return out


def rare_classes(coded: DataFrame, cls: np.ndarray, other: int, table: np.ndarray) -> DataFrame:
    """id, c: every rare word's best class by its own neighbours."""
    given = coded.sparkSession.sparkContext.broadcast(cls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """id, class and slots, a byte for each neighbour, of the rare words of some texts."""
        for _, c, ids, _, c0, ids0 in runs(batches, given.value, other, True):
            own = (ids == ids0) & (ids != 0)
            b, a = ids != 0, (ids0 != 0) & ~own
            word, of = np.concatenate([ids[b], ids0[a]]), np.concatenate([c[b], c0[a]])
            slot = np.concatenate([np.where(own[b], OWN, c0[b]), CLASSES + c[a]]).astype(np.uint8)
            by = np.argsort(word)
            word, of, slot = word[by], of[by], slot[by]
            cut = np.append(np.flatnonzero(np.append(True, word[1:] != word[:-1])), len(word)) if len(word) else np.zeros(1, np.int64)
            for i in range(0, len(cut) - 1, 100_000):
                k = cut[i : i + 100_001]
                yield pa.RecordBatch.from_arrays([pa.array(word[k[:-1]]), pa.array(of[k[:-1]].astype(np.int32)), binary_array(slot[k[0] : k[-1]], k - k[0])], ["id", "c", "slots"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2000):
                b = whole.slice(at, 2000)
                lists = b.column(2)
                data = lists.flatten()
                size = np.array(pc.binary_length(data)).astype(np.int64)
                word = np.repeat(np.repeat(np.arange(len(b)), np.array(lists.value_lengths())), size)
                x = np.bincount(word * SLOTS + np.frombuffer(b"".join(data.to_pylist()), np.uint8), minlength=len(b) * SLOTS).reshape(-1, SLOTS).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(better(table, np.array(b.column(1)).astype(np.int64), x).astype(np.int32))], ["id", "c"])

    sums = coded.mapInArrow(run, "id long, c int, slots binary").groupBy("id").agg(F.first("c").alias("c"), F.collect_list("slots").alias("slots"))
    return sums.select("id", "c", "slots").mapInArrow(place, "id long, c int")


def with_known(coded: DataFrame, words: DataFrame, other: int) -> DataFrame:
    """The coded texts (row, doc_id, z, rare, ...) with `known`: count and class (words: id, n, c) of their rare words."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = [np.frombuffer(x, RARE)["id"] for x in b.column(1).to_pylist()]
            k = np.array([len(x) for x in r], np.int64)
            if k.sum():
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(b.column(0)), k)), pa.array((np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)).astype(np.int32)), pa.array(np.concatenate(r))], ["row", "k", "id"])

    places = coded.select("row", "rare").mapInArrow(explode, "row long, k int, id long")
    found = places.join(words, "id").groupBy("row").agg(F.collect_list("k").alias("ks"), F.collect_list("n").alias("ns"), F.collect_list("c").alias("cs"))
    rest = [c for c in coded.columns if c not in ("row", "z", "rare", "known")]
    joined = coded.drop("known").join(found, "row", "left").select("z", "rare", "ks", "ns", "cs", "row", *rest)
    schema = "z binary, rare binary, known binary, row long" + "".join(f", {c} {coded.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, about = [], []
            for rare, ks, ns, cs in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4))):
                r = np.frombuffer(rare, RARE).copy()
                r["id"] = 0  # has served its purpose, and takes no room as zeros
                x = np.zeros(len(r), KNOWN)
                x["c"] = other
                if ks:
                    x["n"][ks], x["c"][ks] = ns, cs
                out.append(x.tobytes())
                about.append(r.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(about, pa.binary()), pa.array(out, pa.binary()), *b.columns[5:]], ["z", "rare", "known", "row", *rest])

    return joined.mapInArrow(run, schema)


class Model:
    """What the executors need - the head words with their counts and classes, unseen words' classes by bucket and the class tables, all of fixed size -
    and the rare words (id, n, c), which stay a table."""

    def __init__(self, head: Head, head_class: np.ndarray, unseen: np.ndarray, transition: np.ndarray, room: np.ndarray, total: int, kinds: int):
        self.head, self.head_class, self.unseen = head, head_class, unseen
        self.transition, self.room, self.total, self.kinds = transition, room, total, kinds
        self.rare: DataFrame | None = None
        self.likelihoods: list[float] = []

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rare": None}


def previous(flat: np.ndarray, n: np.ndarray, end: int) -> np.ndarray:
    """The token before each; before a text's first, the end."""
    out = np.empty_like(flat)
    out[1:] = flat[:-1]
    out[np.cumsum(n) - n] = end
    return out


def prepared(docs: DataFrame, head, stage: Stage) -> DataFrame:
    """The coded texts with a number for each row, written. As few files as keep all cores busy, since every step reads them."""
    files = max(docs.sparkSession.sparkContext.defaultParallelism, input_bytes(docs) // (64 << 20))
    return stage.write(code(docs, head).coalesce(int(files)).withColumn("row", F.monotonically_increasing_id()).withColumn("known", F.lit(None).cast("binary")), "coded")


def sweeps(texts: DataFrame, cls: np.ndarray, other: int, stage: Stage, most: int = MOST_SWEEPS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """The HEAD's classes after exchange steps until the likelihood stops rising or after `most` sweeps, the table between all classes, and the likelihood by step. A step
    reads the table of the classes that the step before has left, and takes that back if it lowered the likelihood."""
    at, likely, kept = np.arange(len(cls)), [], cls
    k, first = 0, -np.inf
    while True:
        part = k % PARTS
        last = not part and k and (k // PARTS >= most or likely[-1] - first < RISE * abs(first))
        table, x = neighbours(texts, cls, other, None if last else part)
        stage.release()
        now = likelihood(table)
        if likely and now < likely[-1]:
            cls = kept
            if last:
                table, _ = neighbours(texts, cls, other, None)
                return cls, table, likely
            k += 1
            continue
        likely.append(now)
        if last:
            return cls, table, likely
        if not part:
            first = now
        mine, kept = at % PARTS == part, cls
        cls = cls.copy()
        cls[mine] = better(table, kept[mine], x[: mine.sum()])
        cls[0] = 0
        k += 1


def fit(coded: DataFrame, keep: Column, words: DataFrame, head: Head, spent: Stage | None = None) -> tuple[Model, DataFrame]:
    """A model from the coded texts that `keep` holds for, and all coded texts with what is known of their rare words. spent: holds `words`, dropped when they have been read."""
    spark = coded.sparkSession
    stage, lasting = Stage(spark, "classes"), Stage(spark, "vocabulary")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    texts = lambda t: t.where(keep).select("z", "rare", "known", "row")
    core = min(CORE, len(head.n))
    seed = exchange(core_bigrams(texts(coded), core), 0)
    other = int(seed[-1])
    cls = np.full(len(head.n), other, np.int64)
    cls[:core] = seed[:-1]
    cls, table, likely = sweeps(texts(coded), cls, other, stage, 1)
    placed = stage.write(rare_classes(texts(coded), cls, other, table), "placed")
    stage.release()
    rare = lasting.write(words.join(placed, "id").select("id", "bucket", "n", "c"), "rare")
    stage.drop()
    if spent:
        spent.drop()
    stage.release()
    coded = lasting.write(with_known(coded, rare.select("id", "n", "c"), other), "known")
    stage.release()
    cls, table, more = sweeps(texts(coded), cls, other, lasting)
    size, by_bucket = np.zeros(CLASSES), np.zeros((BUCKETS, CLASSES))
    for r in rare.groupBy("bucket", "c").agg(F.count("*").alias("kinds")).collect():
        size[r.c] += r.kinds
        by_bucket[r.bucket, r.c] += r.kinds
    np.add.at(size, cls, 1)
    np.add.at(by_bucket, (head.bucket[1:], cls[1:]), 1)
    unseen = np.where(by_bucket.any(1), by_bucket.argmax(1), max(1, int(size[1:].argmax()) + 1))
    share = (table.sum(0) + 1) / (table.sum() + CLASSES)
    transition = np.log10((table + SMOOTH * share) / (table.sum(1, keepdims=True) + SMOOTH))
    model = Model(head, cls, unseen, transition, table.sum(0) + size + 1, total, kinds)
    model.rare, model.likelihoods = rare, likely + more
    return model, coded


def learn(train: DataFrame, words: DataFrame) -> Model:
    """words: count_words(train), stored. Null texts have the end alone; a null doc_id changes nothing, repeated rows count as often as they are there; after an empty table
    all words are unseen."""
    head = Head(words)
    coded = prepared(train, train.sparkSession.sparkContext.broadcast(head), Stage(train.sparkSession, "train"))
    return fit(coded, F.lit(True), words, head)[0]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row. Null texts count as empty: they have the end alone. Rows may repeat or lack a doc_id; texts of any
    length are read whole; an empty table gives no rows."""
    stage = Stage(docs.sparkSession, "brown")
    coded = prepared(id_text(docs, id_col, text_col), docs.sparkSession.sparkContext.broadcast(model.head), stage)
    return scored(with_known(coded, model.rare.select("id", "n", "c"), 0), model)


def scored(known: DataFrame, model: Model) -> DataFrame:
    """The same of coded texts whose rare words are known."""
    shared = known.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out = []
            for z, rare, about in zip(*(b.column(k).to_pylist() for k in range(3))):
                flat, r, x = decoded(z), np.frombuffer(rare, RARE), np.frombuffer(about, KNOWN)
                at = np.flatnonzero(flat >= FIRST_RARE)
                local = flat[at] - FIRST_RARE
                flat[at] = 0
                n, c = m.head.n[flat], m.head_class[flat]
                n[at], c[at] = x["n"][local], np.where(x["n"] > 0, x["c"], m.unseen[r["bucket"]])[local]
                move = m.transition[previous(c, np.array([len(c)]), 0), c]
                out.append((len(flat), int((n > 0).sum()), float(np.log10((n + 1) / (m.total + m.kinds + 1)).sum()), float((move + np.log10((n + 1) / m.room[c])).sum())))
            yield pa.RecordBatch.from_arrays([b.column(3), *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64())))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    out = known.select("z", "rare", "known", "doc_id").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(int(model.total)).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    stage, counts = Stage(spark, "coded"), Stage(spark, "words")
    words = counts.write(count_words(docs.where(~held_out())), "words")
    head = Head(words)
    stage.release()
    model, known = fit(prepared(docs, spark.sparkContext.broadcast(head), stage), ~held_out(), words, head, counts)
    stage.drop()  # what the scores need is written elsewhere
    return scored(known, model).withColumn("held_out", held_out())
