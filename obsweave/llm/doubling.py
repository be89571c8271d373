"""Removal of repeated passages of WINDOW words by level-wise doubling.

A window that repeats is made of shorter windows that repeat. Windows of FIRST words are counted first; those that occur twice or more are extended to twice that length
and counted again, and so on, until WINDOW words are reached or no candidates survive. Counts are bit filters of bounded size without false negatives: a full
filter lets more candidates through and loses nothing. Candidates of the last length meet by a 96-bit digest of their words, and the first of equal ones in order of
document and place stays.

A task settles what it sees itself before anything moves: of equal windows only its first goes out, in packed runs by digest, so a passage of a third of all
documents costs an entry a run; the others are sent as ranges of words to remove, by document. Texts move once, to meet their ranges."""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, BYTE_VALUE, Stage, Texts, filter_bits, gather_ranges, id_text, in_filter, input_bytes, power_of_two, range_hashes, splitmix, text_slices, twice_seen, word_bounds

WINDOW, FIRST = 20, 5
ENTRIES = 3 << 20  # windows that a task holds before it sends them
OTHER_VALUE = splitmix(np.arange(256) + 0xFACE)
OTHER_BASE = BASE ^ 0x5DEECE66C  # odd too
NONE = 2**63 - 1  # a doc_id that is null: after all others
RECORD = [("h", np.uint64), ("low", np.uint32), ("doc", np.int64), ("text", np.uint64), ("at", np.uint32)]


def levels(window: int = WINDOW, first: int = FIRST) -> list[int]:
    """Lengths that double up to the window; the first is the window halved while that goes and is `first` or more."""
    out = [window]
    while out[0] % 2 == 0 and out[0] // 2 >= first:
        out.insert(0, out[0] // 2)
    return out


class Words:
    """The words of some texts: where each begins and ends, how many words follow it in its text and itself, and hashes of windows."""

    def __init__(self, t: Texts):
        self.t = t
        self.start, self.end, self.count = word_bounds(t)
        self.doc = np.repeat(np.arange(len(t)), self.count)
        self.first = np.cumsum(self.count) - self.count
        self.left = (self.first + self.count)[self.doc] - np.arange(len(self.doc))
        self._hash: dict[tuple[int, int], np.ndarray] = {}

    def hashes(self, n: int, other: bool = False) -> np.ndarray:
        """A hash of the n words from each word on (whatever they are where the text ends before): h(a + b) = h(a) * base**len(b) + h(b). Two families."""
        if (n, other) not in self._hash:
            if n == 1:
                h = range_hashes((OTHER_VALUE if other else BYTE_VALUE)[self.t.buf], self.start, self.end)
            else:
                k = n // 2
                a, b = self.hashes(n - k, other), self.hashes(k, other)
                with np.errstate(over="ignore"):
                    h = a * np.uint64(pow(OTHER_BASE if other else BASE, k, 2**64))
                    h[: len(b) - (n - k)] += b[n - k :]
            self._hash[n, other] = h
        return self._hash[n, other]

    def candidates(self, lengths: list[int], filters: list[np.ndarray]) -> np.ndarray:
        """Places where a window of the last length begins, all of whose halves, and theirs, repeat."""
        at = np.flatnonzero(self.left >= lengths[0])
        ok = np.zeros(len(self.left) + lengths[-1], bool)
        ok[at] = True
        for n, bits in zip(lengths, filters):
            at = at[in_filter(bits, splitmix(self.hashes(n)[at]))]
            ok[:] = False
            ok[at] = True
            at = at[ok[at + n] & (self.left[at] >= 2 * n)]
        return at


def text_hashes(t: Texts) -> np.ndarray:
    return range_hashes(np.append(BYTE_VALUE[t.buf], np.uint64(0)), t.off[:-1], t.off[1:])  # an empty text may stand at the end


def packed(columns: list[np.ndarray], cut: np.ndarray) -> list[bytes]:
    """Runs cut[i]..cut[i+1] of the columns, each squeezed."""
    return [zlib.compress(b"".join(c[a:b].tobytes() for c in columns), 1) for a, b in zip(cut.tolist(), cut[1:].tolist())]


def unpacked(runs: pa.ChunkedArray, types: list[tuple[str, type]]) -> list[np.ndarray]:
    width = sum(np.dtype(ty).itemsize for _, ty in types)
    parts = []
    for x in runs:
        run = zlib.decompress(x.as_buffer())
        n, at, part = len(run) // width, 0, []
        for _, ty in types:
            part.append(np.frombuffer(run, ty, n, at))
            at += n * np.dtype(ty).itemsize
        parts.append(part)
    return [np.concatenate([p[k] for p in parts]) for k in range(len(types))]


def first_of_equal(h, low, doc, text, at) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first of equal windows, and of those that go; a window that is there twice (a row that repeats) counts once."""
    by = np.lexsort((at, text, doc, low, h))
    h, low, doc, text, at = h[by], low[by], doc[by], text[by], at[by]
    new = np.ones(len(by), bool)
    new[1:] = (h[1:] != h[:-1]) | (low[1:] != low[:-1])
    again = np.zeros(len(by), bool)
    again[1:] = ~new[1:] & (doc[1:] == doc[:-1]) & (text[1:] == text[:-1]) & (at[1:] == at[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    same = (doc == doc[lead]) & (text == text[lead]) & (at == at[lead])
    return by[new], by[~again & ~same]


def ranges(doc: np.ndarray, text: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Places as runs: (doc, text, first place, number of places), in order of text hash."""
    by = np.lexsort((at, doc, text))
    doc, text, at = doc[by], text[by], at[by].astype(np.int64)
    new = np.ones(len(by), bool)
    new[1:] = (text[1:] != text[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)
    i = np.flatnonzero(new)
    last = np.append(i[1:], len(by)) - 1
    return [doc[i], text[i], at[i].astype(np.uint32), (at[last] - at[i] + 1).astype(np.uint32)] if len(by) else [doc, text, at.astype(np.uint32), at.astype(np.uint32)]


RUN = [("doc", np.int64), ("text", np.uint64), ("at", np.uint32), ("n", np.uint32)]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256[, kept string] of every row.

    Null and empty texts have no words. A null doc_id comes after all others. Rows that share a doc_id are documents of their own, in order of a hash of their
    texts; rows that share doc_id and text are one document, with a result row for each. Ties within a document go by place. Texts may have any length (up to 2^32
    words). An empty table gives no rows; further columns are not read."""
    base = id_text(docs, id_col, text_col)
    spark = docs.sparkSession
    stage = Stage(spark, "doubling")
    size = input_bytes(base)
    lengths = levels(window)
    filters: list = []  # broadcasts, one for each length before the last
    for n in lengths[:-1]:

        def seen(batches, n=n, before=tuple(lengths[: len(filters)]), at=tuple(filters)):
            for t in text_slices(batches):
                w = Words(t)
                i = w.candidates([*before, n][: len(at)], [f.value for f in at]) if at else np.flatnonzero(w.left >= n)
                if len(i):
                    yield splitmix(w.hashes(n)[i])

        bits = twice_seen(base, seen, size / 2, filter_bits(size / 2, 26))
        filters.append(spark.sparkContext.broadcast(bits))
        stage.release()
        if not bits.any():
            break
    if not all(f.value.any() for f in filters):
        lengths = []  # no candidates survive
    slots, homes = power_of_two(size / (4 << 20), 256, 1 << 20), power_of_two(size / (16 << 20), 64, 1 << 18)
    slot_shift, home_shift = (np.uint64(64 - (k.bit_length() - 1)) for k in (slots, homes))

    def to_homes(runs: list[np.ndarray]) -> tuple[list[int], list[bytes]]:
        cut = np.searchsorted(runs[1] >> home_shift, np.arange(homes + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(cut))
        return full.tolist(), packed(runs, np.append(cut[full], cut[-1]))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First windows by slot of their digest; ranges of the others by home of their text, as slots from -1 down."""

        def flush(held):
            x = [np.concatenate([h[k] for h in held]) for k in range(len(RECORD))]
            stay, go = first_of_equal(*x)
            home, gone = to_homes(ranges(*(x[k][go] for k in (2, 3, 4))))
            y = [c[stay] for c in x]
            cut = np.searchsorted(y[0] >> slot_shift, np.arange(slots + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(cut))
            return pa.RecordBatch.from_arrays([pa.array([*full.tolist(), *(-1 - k for k in home)], pa.int32()), pa.array([*packed(y, np.append(cut[full], cut[-1])), *gone], pa.binary())], ["slot", "run"])

        held, n = [], 0
        for t in text_slices(batches):
            w = Words(t)
            i = w.candidates(lengths[:-1], [f.value for f in filters]) if len(lengths) > 1 else np.flatnonzero(w.left >= window)
            if not len(i):
                continue
            d = w.doc[i]
            ids = np.where(t.null_ids, NONE, t.ids)
            held.append((splitmix(w.hashes(window)[i]), (w.hashes(window, True)[i] >> np.uint64(32)).astype(np.uint32), ids[d], text_hashes(t)[d], (i - w.first[d]).astype(np.uint32)))
            n += len(i)
            if n >= ENTRIES:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    def settle(key, table):
        slot = key[0].as_py()
        if slot < 0:  # already ranges
            return pa.table({"home": pa.array([-1 - slot] * table.num_rows, pa.int32()), "run": table.column("run").cast(pa.binary())})
        x = unpacked(table.column("run"), RECORD)
        go = first_of_equal(*x)[1]
        home, gone = to_homes(ranges(*(x[k][go] for k in (2, 3, 4))))
        return pa.table({"home": pa.array(home, pa.int32()), "run": pa.array(gone, pa.binary())})

    def gather(key, table):
        """A row for each document: the runs of its windows that go."""
        doc, text, at, n = unpacked(table.column("run"), RUN)
        by = np.lexsort((at, doc, text))
        doc, text, at, n = doc[by], text[by], at[by], n[by]
        new = np.ones(len(by), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])
        i = np.flatnonzero(new)
        return pa.table({"doc": pa.array(doc[i]), "digest": pa.array(text[i].view(np.int64)), "gone": pa.array(packed([at, n], np.append(i, len(by))), pa.binary())})

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, gone in text_slices(batches, True):
            w = Words(t)
            edge = np.zeros(len(w.start) + 1, np.int64)
            for i in np.flatnonzero(np.asarray(gone.is_valid())).tolist():
                run = np.frombuffer(zlib.decompress(gone[i].as_buffer()), np.uint32).reshape(2, -1).astype(np.int64)
                at = w.first[i] + run[0]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + run[1] + window - 1, -1)
            stays = np.cumsum(edge[:-1]) == 0
            left = np.add.reduceat(np.append(stays, False), w.first) * (w.count > 0) if len(t) else w.count
            length = (w.end - w.start)[stays] + 1  # each word with a space before it, the first of a text without
            text = np.full(int(length.sum()), 32, np.uint8)
            begin = np.cumsum(length) - length
            text[gather_ranges(begin + 1, length - 1)] = t.buf[gather_ranges(w.start[stays], length - 1)]
            end = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(left)])].tolist()
            whole = text.tobytes()
            kept = [whole[a + 1 : b] for a, b in zip(end, end[1:])]
            out = [t.id_array(), pa.array(w.count.astype(np.int64)), pa.array((w.count - left).astype(np.int64)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.binary()).cast(pa.string())] * keep_text, names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    if not lengths:
        return base.withColumn("gone", F.lit(None).cast("binary")).mapInArrow(results, schema)
    sent = base.mapInArrow(send, "slot int, run binary").groupBy("slot").applyInArrow(settle, "home int, run binary")
    gone = stage.write(sent.groupBy("home").applyInArrow(gather, "doc long, digest long, gone binary"), "gone")
    stage.release()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, texts in text_slices(((pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(1)], ["doc_id", "text", "same"])) for b in batches), True):
            yield pa.RecordBatch.from_arrays([t.id_array(), texts, pa.array(np.where(t.null_ids, NONE, t.ids)), pa.array(text_hashes(t).view(np.int64))], ["doc_id", "text", "doc", "digest"])

    met = base.mapInArrow(keyed, "doc_id long, text string, doc long, digest long").join(gone, ["doc", "digest"], "left")
    return met.select("doc_id", "text", "gone").mapInArrow(results, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: DuckDB SQL for the query's rows.
ORACLE = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 19), ' ')) AS k FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 18, 1))) AS i)
), gone AS (
  SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1
), hit AS (
  SELECT DISTINCT doc_id, i + j AS i FROM gone, range(20) AS r(j)
), word AS (
  SELECT doc_id, i, w[i] AS x FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN hit USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
