"""Removal of repeated 50-byte strings by column-wise construction over a collection of passages.

Every window of WINDOW bytes has one anchor: of its K-byte strings the one with the least hash, the leftmost if equal. Equal windows have equal anchors, so
windows of different documents meet by anchor alone; neighbouring windows with one anchor travel as one passage of at most 2 * WINDOW - K bytes. Only passages whose
anchor occurs twice are moved, which a fixed-size bit filter over all anchors tells without false negatives. Passages that are equal as a whole meet by digest (96 bits) first;
where an anchor has different passages, one document sends the text of each of them, which a second bit filter tells it.

The passages of some anchors, lined up at the anchor, are the collection: from the last column to the first, each round puts one symbol in front of every
passage. The round's symbols in the order of what follows them are the collection's Burrows-Wheeler transform for that column; a stable sort by symbol
gives the next order, and the ends of the common prefixes of neighbours follow as minima over the ranges between equal symbols. Neighbours that agree for
WINDOW bytes are one string; its smallest doc_id settles what goes. Columns are read one after the other and never revisited; they are kept in memory, bounded by
PASSAGES, as a cluster has no scratch files that outlive a task."""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_VALUE, Stage, Texts, binary_array, filter_bits, gather_ranges, id_text, in_filter, input_bytes, power_of_two, range_hashes, splitmix, text_slices, twice_seen

WINDOW, K = 50, 20
SPAN = WINDOW - K  # columns before and after an anchor
PASSAGES = 150_000  # of a collection, a group of one anchor apart
BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
OTHER_VALUE = splitmix(np.arange(256) + 0xFACE)
NONE = 2**63 - 1  # a doc_id that is null: after all others


def passages(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: document (index), first window, number of windows, position of the anchor, hash of the anchor."""
    n = len(t.buf)
    empty = np.zeros(0, np.int64)
    if n < WINDOW:
        return empty, empty, empty, empty, empty.view(np.uint64)
    with np.errstate(over="ignore"):
        h, k, p, four = BYTE_VALUE[t.buf], 1, BASE, None
        while k < 16:
            h = h[:-k] + h[k:] * p
            k, p = 2 * k, p * p
            if k == 4:
                four = h
        h = splitmix(h[: n - K + 1] + four[16 : 16 + n - K + 1] * p)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    k = 1
    while k < 16:
        key = np.minimum(key[:-k], key[k:])
        k *= 2
    key = np.minimum(key[:-15], key[15:])  # SPAN + 1 = 31 anchors to choose from
    at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # windows within one document, and runs of them
    size = np.diff(t.off)
    docs = np.flatnonzero(size >= WINDOW)
    wins = size[docs] - WINDOW + 1
    idx = gather_ranges(t.off[docs], wins)
    doc = np.repeat(docs, wins)
    a = at[idx]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], idx[first], np.diff(np.append(first, len(a))), a[first], splitmix(h[a[first]])  # least hashes are small: mixed anew


def collection(symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For passages (rows of `symbols`, 2 * SPAN + K columns; a row holds columns begin..end-1) with their smallest doc_ids: for every column up to SPAN where
    a window may start, the smallest doc_id that has the same window there, NONE where the row has no window."""
    m, width = symbols.shape
    order = np.arange(m)
    ends = np.full(m, width)  # of the common prefix with the row before, as a column
    out = np.full((m, SPAN + 1), NONE)
    for p in range(width - 1, -1, -1):
        there = (p >= begin) & (p < end)
        column = np.where(there, symbols[:, p].astype(np.int16) + 1, 0)
        bwt = column[order]
        by = np.argsort(bwt, kind="stable")
        same = np.zeros(m, bool)
        same[1:] = (bwt[by[1:]] == bwt[by[:-1]]) & (bwt[by[1:]] > 0)
        nxt = np.full(m, p)
        k = np.flatnonzero(same)
        if len(k):
            low, high = by[k - 1] + 1, by[k] + 1
            step = high - low == 1
            nxt[k[step]] = ends[low[step]]
            far = ~step
            if far.any():
                pairs = np.stack([low[far], high[far]], 1).reshape(-1)
                padded = np.append(ends, width)
                nxt[k[far]] = np.minimum.reduceat(padded, pairs)[::2]
        order, ends = order[by], nxt
        if p <= SPAN:
            ok = there[order] & (p + WINDOW <= end[order])
            start = np.flatnonzero(ends - p < WINDOW)
            best = np.minimum.reduceat(owner[order], start)
            value = np.repeat(best, np.diff(np.append(start, m)))
            out[order[ok], p] = value[ok]
    return out


def spans(mins: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's windows as runs of one smallest doc_id: rows' offsets into the runs, and the runs as (first window, after the last one, doc_id), windows counted from the row's first."""
    valid = mins != NONE
    row, col = np.nonzero(valid)
    v = mins[row, col]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (row[1:] != row[:-1]) | (col[1:] != col[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(v)) - 1
    r = row[first]
    runs = np.stack([col[first] - begin[r], col[last] + 1 - begin[r], v[first]], 1).astype(np.int64)
    return np.searchsorted(r, np.arange(len(mins) + 1)), runs


def seg_hashes(t: Texts, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of 64 and 32 bits."""
    a, b = (range_hashes(v[t.buf], start, start + size) for v in (BYTE_VALUE, OTHER_VALUE))
    return a.view(np.int64), b.astype(np.uint32).view(np.int32)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary] of every row.

    Null texts count as empty. A null doc_id is larger than all others. Rows with one doc_id (or none) remove nothing from each other, as neither is smaller."""
    base = id_text(docs, id_col, text_col)
    spark = docs.sparkSession
    stage = Stage(spark, "suffix")
    size = input_bytes(base)

    def anchors(batches):
        for t in text_slices(batches):
            yield passages(t)[4]

    bits = spark.sparkContext.broadcast(twice_seen(base, anchors, size / 2, filter_bits(size / 8, 26)))

    def result(i, b: bytes, removed: int, runs: int, kept: bytes):
        return (i, len(b), removed, runs, hashlib.sha256(kept).hexdigest(), *([kept] if keep_text else []))

    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if keep_text else [])]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text_slices(batches):
            d, start, wins, at, h = passages(t)
            ok = in_filter(bits.value, h)
            d, start, wins, at, h = d[ok], start[ok], wins[ok], at[ok], h[ok]
            fields = ((start - t.off[d]).astype(np.uint32), wins.astype(np.uint8), (at - start).astype(np.uint8), (h >> np.uint64(32)).astype(np.uint32))
            cut = np.searchsorted(d, np.arange(len(t) + 1)).tolist()
            rows = []
            for i, b, x, y in zip(t.id_array().to_pylist(), t.blobs(), cut, cut[1:]):
                if x == y:
                    rows.append((*result(i, b, 0, 0, b), None, None))
                else:
                    rows.append((i, len(b), 0, 0, None, *([None] if keep_text else []), zlib.compress(b, 1), b"".join(f[x:y].tobytes() for f in fields)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], ty) for k, ty in enumerate([*types, pa.binary(), pa.binary()])], [*names, "z", "marks"])

    table = stage.write(base.mapInArrow(split, f"{schema}, z binary, marks binary").withColumn("row", F.monotonically_increasing_id()), "docs")
    stage.release()
    some = table.where("z IS NOT NULL")

    def marked(batches) -> Iterator[tuple]:
        """Of some documents: texts, rows, and the passages: document, start, windows, lead, anchor, digests of 64 and 32 bits."""
        for b in batches:
            for i in range(0, b.num_rows, 256):
                s = b.slice(i, 256)
                t = Texts(s.column(0).fill_null(NONE), pa.array([zlib.decompress(x.as_buffer()) for x in s.column(1)], pa.large_binary()))
                marks = s.column(2).to_pylist()
                k = np.array([len(m) // 10 for m in marks])
                start, wins, lead, anchor = (np.concatenate([np.frombuffer(m, ty, n, n * o) for m, n in zip(marks, k.tolist())]) for ty, o in ((np.uint32, 0), (np.uint8, 4), (np.uint8, 5), (np.uint32, 6)))
                d = np.repeat(np.arange(len(t)), k)
                start, wins = start.astype(np.int64) + t.off[d], wins.astype(np.int64)
                s1, s2 = seg_hashes(t, start, wins + WINDOW - 1)
                yield t, np.asarray(s.column(3)), d, start, wins, lead, anchor, s1, s2

    packed = [("anchor", np.uint32), ("s2", np.int32), ("s1", np.int64), ("doc", np.int64), ("many", np.uint8)]
    slots = power_of_two(size / (1 << 20), 64, 1 << 16)
    shift = np.uint32(32 - (slots.bit_length() - 1))

    def distinct(s1, s2, doc):
        """Order by digest and doc_id, and where each digest begins."""
        by = np.lexsort((doc, s2, s1))
        new = np.ones(len(by), bool)
        new[1:] = (s1[by[1:]] != s1[by[:-1]]) | (s2[by[1:]] != s2[by[:-1]])
        return by, np.flatnonzero(new)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held):
            anchor, s1, s2, doc = (np.concatenate([x[k] for x in held]) for k in range(4))
            by, first = distinct(s1, s2, doc)
            last = np.append(first[1:], len(by)) - 1
            pick, many = by[first], doc[by[first]] != doc[by[last]]
            to = np.argsort(anchor[pick], kind="stable")
            pick, many = pick[to], many[to]
            cut = np.searchsorted(anchor[pick] >> shift, np.arange(slots + 1, dtype=np.uint32))
            full = np.flatnonzero(np.diff(cut))
            columns = [anchor[pick], s2[pick], s1[pick], doc[pick], many.astype(np.uint8)]
            runs = [b"".join(c[cut[k] : cut[k + 1]].tobytes() for c in columns) for k in full.tolist()]
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(runs, pa.binary())], ["slot", "run"])

        held, n = [], 0
        for t, _, d, _, _, _, anchor, s1, s2 in marked(batches):
            held.append((anchor, s1, s2, t.ids[d]))
            n += len(d)
            if n > 1 << 20:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    def settle(table: pa.Table) -> pa.Table:
        """Of a slot: the passages of several documents whose anchor has no other passage, which are settled by their smallest doc_id; and
        all passages of an anchor that has several, unless one document has them all."""
        parts = []
        for run in table.column("run").to_pylist():
            n, at, part = len(run) // 25, 0, []
            for _, ty in packed:
                part.append(np.frombuffer(run, ty, n, at))
                at += n * np.dtype(ty).itemsize
            parts.append(part)
        anchor, s2, s1, doc, many = (np.concatenate([x[k] for x in parts]) for k in range(len(packed)))
        by, first = distinct(s1, s2, doc)
        last = np.append(first[1:], len(by)) - 1
        pick = by[first]
        several = (np.maximum.reduceat(many[by], first) > 0) | (doc[pick] != doc[by[last]])
        to = np.lexsort((doc[pick], anchor[pick]))
        pick, several = pick[to], several[to]
        own = anchor[pick]
        edge = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        k = np.diff(np.append(edge, len(own)))
        lone = ~np.maximum.reduceat(several, edge) & (doc[pick[edge]] == doc[pick[edge + k - 1]])
        multi = np.repeat(k > 1, k)
        keep = np.where(multi, ~np.repeat(lone, k), several)
        pick, multi = pick[keep], multi[keep]
        return pa.table({"s1": pa.array(s1[pick]), "s2": pa.array(s2[pick]), "doc": pa.array(doc[pick]), "multi": pa.array(multi)})

    plain = some.select("doc_id", "z", "marks", "row")
    seen = stage.write(plain.mapInArrow(digests, "slot int, run binary").groupBy("slot").applyInArrow(settle, "s1 long, s2 int, doc long, multi boolean"), "seen")
    stage.release()

    def sender(s1: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return splitmix(s1.view(np.uint64) ^ splitmix(doc.view(np.uint64)))

    def senders(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            h = sender(*(np.asarray(b.column(k)).astype(np.int64) for k in range(2)))
            yield np.concatenate([h, h])

    wanted = spark.sparkContext.broadcast(twice_seen(seen.where("multi").select("s1", "doc"), senders, size / 8, filter_bits(size / 64, 26)))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _, d, start, wins, lead, anchor, s1, _ in marked(batches):
            q = np.flatnonzero(in_filter(wanted.value, sender(s1, t.ids[d])))
            z = wins[q] + WINDOW - 1
            if len(q):
                seg = binary_array(t.buf[gather_ranges(start[q], z)], np.concatenate([[0], np.cumsum(z)]))
                yield pa.RecordBatch.from_arrays([pa.array(anchor[q].view(np.int32)), pa.array(t.ids[d[q]]), pa.array(lead[q].astype(np.int16)), seg], cols)

    cols = ["anchor", "doc_id", "lead", "seg"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = pa.Table.from_batches(held).combine_chunks()
            _, i, lead = (np.asarray(x.column(c)) for c in cols[:3])
            every = Texts(pa.array(np.zeros(x.num_rows, np.int64)), x.column("seg").combine_chunks())
            s1, s2 = seg_hashes(every, every.off[:-1], np.diff(every.off))
            by, first = distinct(s1, s2, i)
            pick = by[first]
            seg = Texts(pa.array(np.zeros(len(pick), np.int64)), x.column("seg").take(pa.array(pick)).combine_chunks())
            size = np.diff(seg.off)
            begin = SPAN - lead[pick].astype(np.int64)
            width = 2 * SPAN + K
            symbols = np.zeros(len(pick) * width, np.uint8)
            symbols[gather_ranges(np.arange(len(pick)) * width + begin, size)] = seg.buf
            mins = collection(symbols.reshape(-1, width), begin, begin + size, i[pick])
            at, runs = spans(mins, begin)
            k = np.diff(at)
            yield pa.RecordBatch.from_arrays([pa.array(s1[pick]), pa.array(s2[pick]), binary_array(runs.reshape(-1), np.concatenate([[0], np.cumsum(k * 24)]))], ["s1", "s2", "runs"])

        held, rows, last = [], 0, None
        for b in batches:
            a = np.asarray(b.column(0))
            if rows >= PASSAGES:
                k = int(np.argmax(a != last)) if (a != last).any() else len(a)
                if k < len(a):
                    yield from solve([*held, b.slice(0, k)])
                    held, rows, b = [], 0, b.slice(k)
            held.append(b)
            rows += b.num_rows
            last = a[-1]
        if rows:
            yield from solve(held)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size // (16 << 20)))
    sent = plain.mapInArrow(gather, "anchor int, doc_id long, lead short, seg binary")
    found = stage.write(sent.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(build, "s1 long, s2 int, runs binary"), "found")
    stage.release()
    found = found.withColumn("doc", F.lit(None).cast("long")).union(seen.where("NOT multi").select("s1", "s2", F.lit(None).cast("binary"), "doc"))

    def refs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, row, d, start, wins, _, _, s1, s2 in marked(batches):
            yield pa.RecordBatch.from_arrays([pa.array(s1), pa.array(s2), pa.array(row[d]), pa.array(t.ids[d]), pa.array((start - t.off[d]) << 6 | wins)], ["s1", "s2", "row", "doc_id", "place"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bytes to remove, as first << 7 | length: the whole passage, or its runs of windows, where a smaller doc_id has them."""
        for b in batches:
            if not b.num_rows:
                continue
            row, doc, place = (np.asarray(b.column(k)) for k in range(3))
            t = Texts(b.column(0), b.column(3))
            run = np.frombuffer(t.buf.tobytes(), np.int64).reshape(-1, 3)
            at = np.repeat(np.arange(b.num_rows), np.diff(t.off) // 24)
            ok = run[:, 2] < doc[at]
            at, run = at[ok], run[ok]
            whole = np.flatnonzero(np.asarray(b.column(4).fill_null(NONE)) < doc)
            first = np.concatenate([(place[at] >> 6) + run[:, 0], place[whole] >> 6])
            length = np.concatenate([run[:, 1] - run[:, 0], place[whole] & 63]) + WINDOW - 1
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([row[at], row[whole]])), pa.array(first << 7 | length)], ["row", "gone"])

    hits = plain.mapInArrow(refs, "s1 long, s2 int, row long, doc_id long, place long").join(found, ["s1", "s2"]).select("row", "doc_id", "place", "runs", "doc").mapInArrow(ranges, "row long, gone long")
    hits = stage.write(hits.groupBy("row").agg(F.collect_list("gone").alias("gone")), "hits")
    stage.release()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = []
            for i, z, spot in zip(x.column(0).to_pylist(), x.column(1), x.column(2)):
                text = zlib.decompress(z.as_buffer())
                if not spot.is_valid:
                    rows.append(result(i, text, 0, 0, text))
                    continue
                edge = np.zeros(len(text) + 1, np.int64)
                spot = np.asarray(spot.values)
                np.add.at(edge, spot >> 7, 1)
                np.add.at(edge, (spot >> 7) + (spot & 127), -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                rows.append(result(i, text, int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()), kept))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], ty) for k, ty in enumerate(types)], names)

    done = some.join(hits, "row", "left").select("doc_id", "z", "gone").mapInArrow(remove, schema)
    return table.where("z IS NULL").select(*names).union(done)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
