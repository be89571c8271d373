"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash cuts texts into chunks; chunks with the same bytes, in whatever document, are encoded once; a
document's ids are those of its chunks, with each join repaired: the text around the cut is encoded anew,
from one white space to the next, until what lies outside agrees exactly with the chunks' own ids.

Which chunks are shared is settled by a fixed-size bit filter over all chunks' hashes, without false negatives. A
document none of whose chunks may be shared is put together where it is read; only documents with shared chunks
go through the exchange, where equal chunks meet by their bytes."""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import Stage, Texts, filter_bits, id_text, in_filter, input_bytes, splitmix, text_slices, twice_seen
from .tokens import WordEncoder, default_path

MASK_BITS, LEAST, MOST = 11, 256, 16384  # chunks of about 2 KB
WINDOW = 32
GEAR = (splitmix(np.arange(256) + 0xC0DE) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(buf: np.ndarray) -> np.ndarray:
    """Rolling hash of the WINDOW bytes that end at each byte: the sum of GEAR[byte] << age."""
    h = GEAR[buf]
    k = 1
    while k < WINDOW:
        nxt = h.copy()
        nxt[k:] += h[:-k] << np.uint32(k)
        h, k = nxt, 2 * k
    return h


def cut_points(t: Texts) -> list[list[int]]:
    """For each text, the ends of its chunks in the buffer. A cut follows a byte whose rolling hash has its top
    MASK_BITS bits clear, moved on to the next whole character. The first WINDOW bytes of a text take no cut, so cuts depend
    on the text alone."""
    hit = np.flatnonzero(gear_hashes(t.buf) >> np.uint32(32 - MASK_BITS) == 0) + 1
    out, off = [], t.off.tolist()
    lo = np.searchsorted(hit, t.off[:-1] + max(LEAST, WINDOW)).tolist()
    hi = np.searchsorted(hit, t.off[1:]).tolist()
    buf = t.buf
    for a, b, i, j in zip(off, off[1:], lo, hi):
        ends, last = [], a
        for p in [*hit[i:j].tolist(), b]:
            while p - last > MOST:
                q = last + MOST
                while q > last + 1 and buf[q] & 0xC0 == 0x80:
                    q -= 1
                ends.append(q)
                last = q
            while p < b and buf[p] & 0xC0 == 0x80:
                p += 1
            if p < b and p - last < LEAST:
                continue
            ends.append(p)
            last = p
        if len(ends) > 1 and ends[-1] == ends[-2]:
            ends.pop()
        out.append(ends)
    return out


def chunks(t: Texts) -> list[list[bytes]]:
    whole = t.buf.tobytes()
    out = []
    for a, ends in zip(t.off.tolist(), cut_points(t)):
        out.append([whole[x:y] for x, y in zip([a, *ends], ends)])
    return out


def chunk_hash(c: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(c, digest_size=8).digest(), "little")


WHITE = b" \t\n\r\x0b\x0c"


def _head(c: bytes) -> int:
    """Length of what precedes the first white space; all of it if there is none."""
    return len(c.split(None, 1)[0]) if c[:1] not in WHITE and c.split(None, 1) else 0 if c else 0


def _tail(c: bytes) -> int:
    return len(c.rsplit(None, 1)[-1]) if c and c[-1:] not in WHITE else 0


def join_ids(parts: list[bytes], ids: list[bytes], enc: WordEncoder) -> bytes:
    """ids of the parts' concatenation from those of the parts.

    At a cut inside a word, the last word of what is there so far and the first of what follows are taken off -
    their own ids must agree with the ends of the chunks' ids, else the whole text is encoded anew - and
    encoded as one."""
    done: list[bytes] = []  # ids that no later part can change
    word = b""  # what follows the last white space so far; its ids are not in `done`
    for c, own in zip(parts, ids):
        h, t = _head(c), _tail(c)
        if h == len(c):  # no white space: the word goes on
            word += c
            continue
        first = enc.text(c[:h]) if h else b""
        last = enc.text(c[len(c) - t :]) if t else b""
        if own[: len(first)] != first or (last and own[-len(last) :] != last) or len(own) < len(first) + len(last):
            return enc.text(b"".join(parts))
        if word or h:
            joined = word + c[:h]
            done.append(enc.text(joined) if word else first)
        done.append(own[len(first) : len(own) - len(last)])
        word = c[len(c) - t :] if t else b""
    if word:
        done.append(enc.text(word))
    return b"".join(done)


def shared_filter(docs: DataFrame) -> np.ndarray:
    def hashes(batches):
        for t in text_slices(batches):
            yield np.array([chunk_hash(c) for cs in chunks(t) for c in cs], np.uint64)

    return twice_seen(docs, hashes, input_bytes(docs) / 100, filter_bits(input_bytes(docs) / 64, 24))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, ids): the ids of every text as little-endian unsigned integers of the encoder's width. With `digest`, doc_id, n_tokens,
    ids_sha256 and decoded_sha256 instead, made by the worker that has the ids.

    Null texts count as empty; rows are kept whatever their doc_id, equal or null."""
    path = path or default_path()
    base = id_text(docs, id_col, text_col)
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(shared_filter(base))

    names_ = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "ids"]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids binary"

    def columns(runs: list[bytes], enc: WordEncoder) -> list[pa.Array]:
        if not digest:
            return [pa.array(runs, pa.binary())]
        d = [digests_of(r, enc) for r in runs]
        return [pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.string()), pa.array([x[2] for x in d], pa.string())]

    def split(batches: Iterator[pa.RecordBatch], alone: bool) -> Iterator[pa.RecordBatch]:
        enc = WordEncoder.get(path)
        for t in text_slices(batches):
            cs = chunks(t)
            n = np.array([len(c) for c in cs])
            may = in_filter(bits.value, np.array([chunk_hash(c) for x in cs for c in x], np.uint64)).astype(np.int64)
            cum = np.concatenate([[0], np.cumsum(may)])
            at = np.concatenate([[0], np.cumsum(n)])
            own = cum[at[1:]] == cum[at[:-1]]
            if alone:
                keep = np.flatnonzero(own).tolist()
                flat = enc.texts([c for i in keep for c in cs[i]])
                out, k = [], 0
                for i in keep:
                    out.append(join_ids(cs[i], flat[k : k + len(cs[i])], enc))
                    k += len(cs[i])
                yield pa.RecordBatch.from_arrays([t.id_array().take(pa.array(keep, pa.int64())), *columns(out, enc)], names_)
            else:
                rows = [(i, k, zlib.compress(c, 1)) for i in np.flatnonzero(~own).tolist() for k, c in enumerate(cs[i])]  # equal chunks stay equal
                which = pa.array([r[0] for r in rows], pa.int64())
                # a row's own name: rows with one doc_id stay apart
                names = {i: hashlib.blake2b(t.blob(i), digest_size=16).digest() for i in set(which.to_pylist())}
                yield pa.RecordBatch.from_arrays([t.id_array().take(which), pa.array([names[r[0]] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["doc_id", "name", "seq", "chunk"])

    single = base.mapInArrow(lambda b: split(b, True), schema)
    refs = base.mapInArrow(lambda b: split(b, False), "doc_id long, name binary, seq int, chunk binary")
    refs = Stage(spark, "bpe").write(refs, "refs")

    def encode_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = WordEncoder.get(path)
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                s = b.slice(i, 1024)
                ids = enc.texts([zlib.decompress(c) for c in s.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array([zlib.compress(x, 1) for x in ids], pa.binary())], ["chunk", "ids"])

    once = refs.select("chunk").distinct().mapInArrow(encode_chunks, "chunk binary, ids binary")
    placed = refs.join(once, "chunk").select("doc_id", "name", "seq", "chunk", "ids")

    def put_together(key, table):
        enc = WordEncoder.get(path)
        seq = table.column("seq").to_pylist()
        cols = sorted({k: (k, c, i) for k, c, i in zip(seq, table.column("chunk").to_pylist(), table.column("ids").to_pylist())}.values())
        ids = join_ids([zlib.decompress(c[1]) for c in cols], [zlib.decompress(c[2]) for c in cols], enc)
        times = seq.count(0)  # rows with the same doc_id and text come out as often as they went in
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * times, pa.int64()), *columns([ids] * times, enc)], names_)

    return single.union(placed.groupBy("doc_id", "name").applyInArrow(put_together, schema))


def decode(ids: bytes, enc: WordEncoder) -> str:
    """The library's decode(ids, skip_special_tokens=False): without a decoder, tokens with a space between them."""
    return " ".join([enc.names[i] for i in np.frombuffer(ids, enc.dtype).tolist()])


def digests_of(ids: bytes, enc: WordEncoder) -> tuple[int, str, str]:
    """n_tokens, ids_sha256, decoded_sha256."""
    if enc.tokenizer.decoder is not None:
        raise ValueError("this file has a decoder of its own")
    n = np.frombuffer(ids, enc.dtype).tolist()
    return len(n), hashlib.sha256(" ".join(map(str, n)).encode()).hexdigest(), hashlib.sha256(decode(ids, enc).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
