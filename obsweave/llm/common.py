"""Shared plumbing of the corpus operators: text batches as numpy buffers, staged tables, bounded filters."""
from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that are turned into numpy temporaries at once; bounds a worker's memory.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch, where the session has the default.
ROWS = 1000


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def tune(spark: SparkSession) -> None:
    """Thousands of whole texts to an Arrow batch would be much for a worker; a session's own setting stays."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)


class Stage:
    """Tables written under spark.checkpoint.dir, which every executor shares; unlike localCheckpoint, they
    survive the loss of executors. Removed with `drop`, with `dropped_after`, or when the interpreter ends. Where the setting
    is missing, only a session in one process may go on: on a cluster a folder of its own would lose rows."""

    live: list["Stage"] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        tune(spark)
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = "file://" + os.path.join(tempfile.gettempdir(), "obsweave-stage")
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        Stage.live.append(self)
        atexit.register(self.drop)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Lets Spark delete shuffle files that nothing refers to any more, which it does when the driver collects its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str = "") -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session may have ended
            pass
        if not name and self in Stage.live:
            Stage.live.remove(self)
            atexit.unregister(self.drop)

    @staticmethod
    def dropped_after(first: int, last: int | None = None) -> None:
        """Drops the tables of all stages made since there were `first` of them."""
        for stage in Stage.live[first:last]:
            stage.drop()


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the plan's size; file sizes for plain scans, 1 GB where it knows nothing."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else 1 << 30


def power_of_two(n: float, least: int, most: int) -> int:
    return int(min(most, max(least, 1 << max(0, int(np.ceil(np.log2(max(n, 1))))))))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that operators read, under fixed names; further columns never reach them."""
    tune(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


class Texts:
    """Some documents: ids (numpy int64, with a mask of nulls) and their UTF-8 bytes back to back."""

    __slots__ = ("ids", "null_ids", "buf", "off")

    def __init__(self, ids: pa.Array, texts: pa.Array):
        self.null_ids = np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(0)).astype(np.int64, copy=False)
        a = pc.fill_null(texts, "").cast(pa.large_binary())
        off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
        data = a.buffers()[2] if len(a) else None
        self.buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.off = off - off[0]

    def __len__(self) -> int:
        return len(self.ids)

    def id_array(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.null_ids)

    def blob(self, i: int) -> bytes:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes()

    def blobs(self) -> list[bytes]:
        whole, o = self.buf.tobytes(), self.off.tolist()
        return [whole[a:b] for a, b in zip(o, o[1:])]


def text_slices(batches: Iterable[pa.RecordBatch], third: bool = False, limit: int = SLICE_BYTES) -> Iterator:
    """Cuts Arrow batches (doc_id, text) into runs of whole documents of about `limit` bytes. A longer text
    is a run of its own. With `third`, pairs of those and the third column."""
    for b in batches:
        ids, texts = b.column(0), b.column(1)
        if not len(ids):
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
        part = (np.cumsum(size) - size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
        for i, j in zip(cuts, cuts[1:]):
            if j > i:
                t = Texts(ids.slice(i, j - i), texts.slice(i, j - i))
                yield (t, b.column(2).slice(i, j - i)) if third else t
        trim()


def trim() -> None:
    """Gives freed memory back to the system, so that a worker's size is what it uses."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another libc
        pass


def map_texts(df: DataFrame, fn: Callable[[Texts], pa.RecordBatch | None], schema: str) -> DataFrame:
    """fn over runs of whole documents; df has (doc_id, text) first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text_slices(batches):
            if (out := fn(t)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def binary_array(data: np.ndarray, off: np.ndarray) -> pa.Array:
    """A binary column from bytes back to back and offsets."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))]).cast(pa.binary())


def gather_ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[i]..start[i]+length[i]-1, back to back."""
    total = int(length.sum())
    first = np.cumsum(length) - length
    return np.repeat(start - first, length) + np.arange(total)


def splitmix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def is_space() -> np.ndarray:
    """The white space that separates words: \\x20 and \\x09-\\x0D."""
    t = np.zeros(256, bool)
    t[[32, *range(9, 14)]] = True
    return t


SPACE = is_space()


def lower_ascii() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_ascii()


def word_bounds(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and how many words each text has. Words end where texts end."""
    gap = np.ones(len(t.buf) + 2, bool)
    gap[1:-1] = SPACE[t.buf]
    starts = (gap[:-2] | _edge(t)[:-1]) & ~gap[1:-1] if len(t.buf) else np.zeros(0, bool)
    ends = (gap[2:] | _edge(t)[1:]) & ~gap[1:-1] if len(t.buf) else np.zeros(0, bool)
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.diff(np.searchsorted(s, t.off))


def _edge(t: Texts) -> np.ndarray:
    at = np.zeros(len(t.buf) + 1, bool)
    at[t.off] = True
    return at


#: Base of the rolling polynomial: odd, and 5 modulo 8, so that its powers have the longest period modulo 2**64.
BASE = 0xD1342543DE82EF95


INVERSE = pow(BASE, -1, 2**64)


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    k, p = 1, base
    with np.errstate(over="ignore"):
        while k < n:
            m = min(k, n - k)
            out[k : k + m] = out[:m] * np.uint64(p)
            k, p = k * 2, p * p % 2**64
    return out[:n]


def range_hashes(value: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of value[start:end] for each range, whatever lies before it."""
    if not len(start):
        return np.zeros(0, np.uint64)
    pw, inv = power_tables(len(value))
    with np.errstate(over="ignore"):
        pre = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value * pw, out=pre[1:])
        h = (pre[end] - pre[start]) * inv[start]
        return splitmix(h + splitmix((end - start).astype(np.uint64)))


_tables = [np.zeros(0, np.uint64)] * 2


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n; kept by the worker up to twice the usual run."""
    if len(_tables[0]) < n:
        made = [powers(max(n, SLICE_BYTES), b) for b in (BASE, INVERSE)]
        if n > 2 * SLICE_BYTES:
            return made[0][:n], made[1][:n]
        _tables[:] = made
    return _tables[0][:n], _tables[1][:n]


#: A random value for each byte, from a rule.
BYTE_VALUE = splitmix(np.arange(256) + 0x5EED)


#: Largest filter, in bits by powers of two: 128 MB in a worker.
MOST_FILTER_BITS = 30


def filter_bits(size: float, least: int) -> int:
    """Bits of a filter over an input, by powers of two: one bit for so many bytes of input as keeps the load low, at most MOST_FILTER_BITS; beyond that the filter fills up, so
    that more rows are moved, and results stay."""
    return power_of_two(size, 1 << least, 1 << MOST_FILTER_BITS).bit_length() - 1


def twice_seen(df: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], stage_bytes: int, filter_bits: int = 26, least_docs: int = 2) -> np.ndarray:
    """A bit filter (2**filter_bits bits, indexed by the top bits of a hash) of the 64-bit hashes that `hashes`
    yields twice or more. It has no false negatives and its size is fixed, so it may be broadcast; when it
    fills up, more rows pass and nothing is lost.

    Hashes go out in packed runs by their top bits, made distinct per run beforehand, so that a hash that
    occurs in a third of all documents costs one entry a run. Slots grow with the input."""
    slots = power_of_two(stage_bytes / (4 << 20), 64, 1 << 16)
    shift = 64 - (slots.bit_length() - 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            x, n = np.unique(np.concatenate(held), return_counts=True)
            x = np.concatenate([x, x[n > 1]])  # twice is all that matters
            x.sort()
            cut = np.searchsorted(x >> np.uint64(shift), np.arange(slots + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(cut))
            low = (x >> np.uint64(shift - 32)).astype(np.uint32)  # 32 bits below the slot's: equal ones are few by chance
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), binary_array(low, np.append(cut[full], cut[-1]) * 4)], ["slot", "run"])

        held, n = [], 0
        for h in hashes(batches):
            held.append(h)
            n += len(h)
            if n >= 1 << 20:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    slice_bits = filter_bits - (slots.bit_length() - 1)

    def count(key, table):
        slot = key[0].as_py()
        x = np.sort(np.frombuffer(b"".join(table.column("run").to_pylist()), np.uint32))
        again = x[1:][x[1:] == x[:-1]]
        bits = np.zeros(1 << max(slice_bits, 3), np.uint8)
        bits[(again >> np.uint32(32 - slice_bits)).astype(np.int64)] = 1
        return pa.table({"slot": pa.array([slot], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()])})

    packed = df.mapInArrow(pack, "slot int, run binary")
    out = np.zeros(1 << (filter_bits - 3), np.uint8)
    each = (1 << slice_bits) >> 3
    for r in packed.groupBy("slot").applyInArrow(count, "slot int, bits binary").toLocalIterator():
        out[r.slot * each : (r.slot + 1) * each] = np.frombuffer(r.bits, np.uint8)
    return out


def in_filter(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def components(edges: DataFrame, stage: Stage, name: str) -> DataFrame:
    """Connected components of edges (a, b): rows (node, comp), comp the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014), which converge in about log(n)**2
    rounds even on long chains. Every round is a table in the shared folder; only a count and a sum reach
    the driver."""
    both = lambda e: e.select("a", "b").where("a <> b")
    cur = stage.write(both(edges).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    last, k = None, 0
    while True:
        undirected = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = undirected.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = undirected.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a > b")
        low2 = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low2, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        k += 1
        nxt = stage.write(small, f"{name}-{k}")
        stage.drop(f"{name}-{k - 1}")
        cur = nxt
        now = tuple(cur.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last or not now[0]:
            break
        last = now
    return cur.select(F.col("a").alias("node"), F.col("b").alias("comp"))
