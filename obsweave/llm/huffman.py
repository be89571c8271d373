"""Token-ID files: canonical length-limited Huffman coding of ids from global counts.

File format. A file is a table of rows (part, block): `part` orders the shards, `block` is a binary. The
row with a null part holds the code book. A block is self-contained and holds whole documents in ascending
doc_id order:

  b"HUF1", then little-endian uint32: documents, tokens, tokens per checkpoint, bytes of payload
  int64 doc_id of each document; uint8 1 where doc_id is null; uint32 tokens of each document
  uint32 bit offset in the payload of every checkpoint; payload, most significant bit first

Code book: b"HUFB", uint32 limit, uint32 ids, uint8 code length of each id (0: never occurs). Codes are
canonical: by length, then id. Blocks decode independently of each other: every checkpoint starts a lane, and
all lanes of a block step through one look-up table of 2**limit entries together."""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, id_text, map_texts
from .tokens import WordEncoder, default_path

LIMIT = 16  # bits of the longest code; 2**LIMIT entries in the decoding table
LANE = 64  # tokens between checkpoints
BLOCK_TOKENS = 1 << 18


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits, by package-merge; 0 for ids without a count."""
    out = np.zeros(len(counts), np.uint8)
    ids = np.flatnonzero(counts)
    if not len(ids):
        return out
    if len(ids) == 1:
        out[ids] = 1
        return out
    if len(ids) > 1 << limit:
        raise ValueError(f"{len(ids)} ids can't have codes of {limit} bits")
    order = ids[np.argsort(counts[ids], kind="stable")]
    leaf = counts[order].astype(np.int64)
    n = len(leaf)
    # made[k]: which entries of level k's sorted list are leaves
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        merged = np.concatenate([leaf, packages])
        by = np.argsort(merged, kind="stable")
        levels.append(by < n)
        merged = merged[by]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take, length = 2 * n - 2, np.zeros(n, np.int64)
    for leaves in reversed(levels):
        k = int(leaves[:take].sum())  # the lightest leaves come first
        length[:k] += 1
        take = 2 * (take - k)
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes by id, and the ids that occur in code order."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.argsort(lengths[ids], kind="stable")]
    codes = np.zeros(len(lengths), np.uint64)
    if len(ids):
        n = lengths[ids].astype(np.int64)
        top = int(n[-1])
        first = np.concatenate([[0], np.cumsum(1 << (top - n))[:-1]])  # left-aligned codes
        codes[ids] = (first >> (top - n)).astype(np.uint64)
    return codes, ids


def decode_table(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For every `limit` next bits: the id and its code length."""
    _, ids = canonical(lengths)
    n = lengths[ids].astype(np.int64)
    span = 1 << (limit - n)
    sym = np.repeat(ids, span).astype(np.uint32)
    size = np.repeat(n, span).astype(np.uint8)
    pad = (1 << limit) - len(sym)  # codes that no id has, and what follows the last bit
    return np.concatenate([sym, np.zeros(pad, np.uint32)]), np.concatenate([size, np.ones(pad, np.uint8)])


def pack_bits(code: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Payload bytes, and the bit offset of every code. Codes are at most 32 bits long."""
    length = length.astype(np.int64)
    at = np.cumsum(length) - length
    total = int(length.sum())
    words = np.zeros(total // 64 + 2, np.uint64)
    w, room = at >> 6, 64 - (at & 63) - length
    whole = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    if len(w):
        first = np.flatnonzero(np.diff(w, prepend=-1))
        words[w[first]] = np.add.reduceat(whole, first)  # codes don't overlap: sum is or
        over = np.flatnonzero(room < 0)
        words[w[over] + 1] += code[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").view(np.uint8)[: (total + 7) // 8], at


def encode_block(ids: list[int | None], runs: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray, lane: int = LANE) -> bytes:
    flat = np.concatenate(runs) if runs else np.zeros(0, np.int64)
    payload, at = pack_bits(codes[flat], lengths[flat])
    head = np.array([len(ids), len(flat), lane, len(payload)], "<u4")
    parts = [b"HUF1", head, np.array([i or 0 for i in ids], "<i8"), np.array([i is None for i in ids], np.uint8), np.array([len(r) for r in runs], "<u4"), at[::lane].astype("<u4"), payload]
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)


def decode_block(block: bytes, table: tuple[np.ndarray, np.ndarray], limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, which of them are null, tokens of each document, and all ids in turn."""
    if block[:4] != b"HUF1":
        raise ValueError("not a block of token ids")
    docs, tokens, lane, size = np.frombuffer(block, "<u4", 4, 4).astype(int).tolist()
    k = 20
    ids = np.frombuffer(block, "<i8", docs, k)
    null = np.frombuffer(block, np.uint8, docs, k := k + 8 * docs).astype(bool)
    n = np.frombuffer(block, "<u4", docs, k := k + docs)
    lanes = -(-tokens // lane)
    pos = np.frombuffer(block, "<u4", lanes, k := k + 4 * docs).astype(np.int64)
    data = np.zeros(size + 4, np.uint32)
    data[:size] = np.frombuffer(block, np.uint8, size, k + 4 * lanes)
    ahead = data[:-3] << np.uint32(24) | data[1:-2] << np.uint32(16) | data[2:-1] << np.uint32(8) | data[3:]
    sym, length = table
    out = np.empty((lanes, lane), np.uint32)
    last = len(ahead) - 1
    for j in range(lane if lanes else 0):
        v = ahead[np.minimum(pos >> 3, last)]
        v = (v << (pos & 7).astype(np.uint32)) >> np.uint32(32 - limit)
        out[:, j] = sym[v]
        pos += length[v]
    return ids, null, n.astype(np.int64), out.reshape(-1)[:tokens]


def encode_table(docs: DataFrame, path: str, end_id: int | None) -> DataFrame:
    """(doc_id, ids, n): the ids of every text, then end_id."""

    def encode(t):
        enc = WordEncoder.get(path)
        tail = np.array([end_id], enc.dtype).tobytes() if end_id is not None else b""
        runs = [r + tail for r in enc.texts(t.blobs())]
        return pa.RecordBatch.from_arrays([t.id_array(), pa.array(runs, pa.binary()), pa.array([len(r) // enc.dtype.itemsize for r in runs], pa.int64())], ["doc_id", "ids", "n"])

    return map_texts(docs, encode, "doc_id long, ids binary, n long")


def count_ids(table: DataFrame, dtype: str, size: int) -> np.ndarray:
    """How often each id occurs in all documents. A task sends one row for each id it met; the driver gets at
    most one for each id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for b in batches:
            for r in b.column(0):
                n += np.bincount(np.frombuffer(r.as_buffer(), dtype), minlength=size) if len(r.as_buffer()) > 2 * size else 0
            short = [r.as_py() for r in b.column(0) if len(r.as_buffer()) <= 2 * size]
            n += np.bincount(np.frombuffer(b"".join(short), dtype), minlength=size)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(n[met])], ["id", "n"])

    out = np.zeros(size, np.int64)
    for r in table.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


def write_ids(table: DataFrame, lengths: np.ndarray, dtype: str, limit: int, stage: Stage, name: str = "file") -> DataFrame:
    """Writes (doc_id, ids) as a file in the format above and returns it as read back: (part, start, tokens, block);
    start counts the part's tokens before the block. Ties in doc_id are ordered by their ids."""
    codes, _ = canonical(lengths)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, ids, runs, held = None, 0, [], [], 0

        def cut() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([start], pa.int64()), pa.array([held], pa.int64()), pa.array([encode_block(ids, runs, lengths, codes)], pa.binary())], ["part", "start", "tokens", "block"])

        for b in batches:
            for i, r in zip(b.column(0).to_pylist(), b.column(1)):
                part = (i if i is not None else -(2**63)) if part is None else part
                run = np.frombuffer(r.as_buffer(), dtype)
                ids.append(i)
                runs.append(run)
                held += len(run)
                if held >= BLOCK_TOKENS:
                    yield cut()
                    start, ids, runs, held = start + held, [], [], 0
        if ids:
            yield cut()

    ordered = table.select("doc_id", "ids").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    book = b"HUFB" + np.array([limit, len(lengths)], "<u4").tobytes() + lengths.tobytes()
    head = table.sparkSession.createDataFrame([(None, 0, 0, bytearray(book))], "part long, start long, tokens long, block binary")
    return stage.write(ordered.mapInArrow(blocks, "part long, start long, tokens long, block binary").union(head), name)


def read_ids(file: DataFrame, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document of a file. The driver reads the code book and a
    count for each shard."""
    book = bytes(file.where("part IS NULL").first().block)
    limit, size = np.frombuffer(book, "<u4", 2, 4).astype(int).tolist()
    lengths = np.frombuffer(book, np.uint8, size, 12)
    before, total = {}, 0
    for r in sorted(file.where("part IS NOT NULL").groupBy("part").agg(F.sum("tokens").alias("n")).collect(), key=lambda r: r.part):
        before[r.part], total = total, total + r.n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths, limit)
        for b in batches:
            for part, start, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                ids, null, n, flat = decode_block(block.as_py(), table, limit)
                raw = memoryview(flat.astype("<u4").tobytes())
                cut = np.concatenate([[0], np.cumsum(n)])
                cols = [pa.array(ids, mask=null), pa.array(before[part] + start + cut[:-1]), pa.array(n), pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.int64())]
                if keep_ids:
                    cols.append(pa.array([bytes(raw[4 * x : 4 * y]) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return file.where("part IS NOT NULL").select("part", "start", "block").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)


def token_file(docs: DataFrame, path: str | None = None, end_id: int | None = 1, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", to: str | None = None) -> DataFrame:
    """Encodes every text, writes the Huffman-coded file and returns it as read back. to: a folder that does not exist yet, where the file stays; else it goes with the session.

    Null texts count as empty and have the end id alone; null doc_ids come first; equal doc_ids stay apart. An empty
    table gives a file with a code book and no block."""
    path = path or default_path()
    enc = WordEncoder.get(path)
    stage = Stage(docs.sparkSession, "huffman")
    table = stage.write(encode_table(id_text(docs, id_col, text_col), path, end_id), "ids")
    counts = count_ids(table, enc.dtype.str, enc.size)
    file = write_ids(table, code_lengths(counts, limit), enc.dtype.str, limit, stage)
    if to:
        file.write.parquet(to)
        file = docs.sparkSession.read.schema(file.schema).parquet(to)
        stage.drop()
    else:
        stage.drop("ids")
    return file


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ids(token_file(spark.read.parquet(f"{sf_dir}/documents.parquet")))
