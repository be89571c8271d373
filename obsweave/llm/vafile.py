"""Product codes of vectors whose nearest codebook entries are found through a vector approximation.

Components become integers, vectors are cut into PARTS equal parts, and each part position has a codebook of ENTRIES entries. An entry's coordinates are kept as cells of
2**BITS a dimension; for a part to assign, a table of each cell's least and greatest squared distance in each dimension gives every entry a lower and an upper bound by
look-ups and sums. Only entries whose lower bound does not exceed the least upper bound are measured, in integers, so the answer is that of a full search.

A round is one pass over the integers: each task adds up its parts by entry (PARTS * ENTRIES rows a task at most), Spark adds up the tasks, and the codebooks, of a fixed
size, are all that the driver holds."""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, tune

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BITS = 4  # of a cell of one coordinate
ROWS = 1024  # vectors that are looked at together


def largest(size: int) -> int:
    """Components beyond this count as this, so that a vector's squared distances add up within 63 bits."""
    return math.isqrt((2**63 - 1) // max(size, 1)) // 2


class Cells:
    """A codebook (entries x width) with its coordinates as cells."""

    def __init__(self, book: np.ndarray, bits: int = BITS):
        self.book = book
        low = book.min(0)
        wide = (book.max(0) - low >> bits) + 1
        self.cell = (book - low) // wide
        edge = low[:, None] + np.arange(1 << bits) * wide[:, None]  # first and last integer of each cell
        self.first, self.last = edge, edge + wide[:, None] - 1

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances of parts (n x width) to all entries (n x entries)."""
        x = parts[:, :, None]
        below, above = self.first - x, x - self.last
        least = np.maximum(np.maximum(below, above), 0) ** 2
        most = np.maximum(np.abs(below), np.abs(above)) ** 2
        d = np.arange(parts.shape[1])
        return least[:, d, self.cell].sum(2), most[:, d, self.cell].sum(2)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entries (the lower of equally near ones), squared distances, and how many distances were measured."""
        low, high = self.bounds(parts)
        row, entry = np.nonzero(low <= high.min(1, keepdims=True))
        far = ((parts[row] - self.book[entry]) ** 2).sum(1)
        start = np.searchsorted(row, np.arange(len(parts)))
        best = np.minimum.reduceat(far, start)
        hit = np.flatnonzero(far == best[row])
        own, at = np.unique(row[hit], return_index=True)
        return entry[hit[at]], best, len(row)


def codebooks(seed: np.ndarray) -> np.ndarray:
    """Seed vectors (n x dim, n up to ENTRIES) as PARTS codebooks (PARTS x n x width)."""
    return seed.reshape(len(seed), PARTS, -1).transpose(1, 0, 2).copy()


def vectors(batch: pa.RecordBatch, at: int, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(at).to_pylist()), "<i8").reshape(-1, size)


def as_integers(vecs: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """vec_id, label, n (dimensions), q (64-bit integers); without vectors that are null, are empty, can't be cut or hold what is no finite number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(2)
            v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
            n = np.asarray(pc.fill_null(pc.list_value_length(v), 0)).astype(np.int64)
            flat = np.asarray(pc.fill_null(v.flatten().cast(pa.float64()), np.nan))
            end = np.cumsum(n)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            ok = np.flatnonzero((n > 0) & (n % PARTS == 0) & (bad[end] == bad[end - n]))
            rows = []
            for i in ok.tolist():
                most = largest(int(n[i]))
                rows.append(np.clip(np.floor(flat[end[i] - n[i] : end[i]] * SCALE), -most, most).astype("<i8").tobytes())
            pick = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pick), b.column(1).take(pick), pa.array(n[ok].astype(np.int32)), pa.array(rows, pa.binary())], ["vec_id", "label", "n", "q"])

    kind = dict(vecs.dtypes)[label_col]
    return vecs.select(vecs[id_col].cast("long").alias("vec_id"), vecs[label_col].alias("label"), vecs[vec_col].cast("array<double>").alias("v")).mapInArrow(run, f"vec_id long, label {kind}, n int, q binary")


def codes(vecs: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable vector; codebooks are learned from all of them.

    Vectors that are null, empty, of a length that PARTS does not divide, or hold null or non-finite components are dropped, and so are those of another length than the
    first vector kept. The first codebooks come from the smallest vec_ids (null last; of equal ids the smaller integers); fewer vectors than ENTRIES make smaller codebooks. Components
    beyond `largest(dimensions)` (46,000 before scaling at 64 dimensions) count as that. Repeated rows are vectors like any others, a null label is a label, an empty table gives no rows, further columns are
    not read."""
    spark = vecs.sparkSession
    tune(spark)
    stage = Stage(spark, "codes")
    table = stage.write(as_integers(vecs, id_col, vec_col, label_col), "ints")
    order = [F.col("vec_id").asc_nulls_last(), "q"]
    first = table.orderBy(*order).select("n").first()
    if first is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    size = int(first.n)
    table = table.where(F.col("n") == size)
    seed = table.orderBy(*order).limit(ENTRIES).select("q").collect()
    book = codebooks(np.stack([np.frombuffer(r.q, "<i8") for r in seed]))
    for _ in range(ROUNDS):
        book = moved(table, book, size)
    text = ",".join(map(str, book.reshape(-1).tolist()))
    done = stage.write(assigned(table, book, size), "codes")
    sums = stage.write(done.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    stage.drop("ints")
    d, s = done.alias("d"), sums.alias("s")  # a small table of labels is sent to all tasks by its size on disk; of a large one Spark splits labels that hold many rows
    return d.join(s, F.col("d.label").eqNullSafe(F.col("s.label"))).select("d.vec_id", "d.code", "d.error", "s.label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def moved(table: DataFrame, book: np.ndarray, size: int) -> np.ndarray:
    """Codebooks after a round: every entry is the floor of the mean of the parts nearest to it, unused ones stay."""
    width = size // PARTS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in book]
        count, total = np.zeros(book.shape[:2], np.int64), np.zeros(book.shape, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                q = vectors(b.slice(i, ROWS), 0, size)
                for p, c in enumerate(cells):
                    part = q[:, p * width : (p + 1) * width]
                    entry = c.nearest(part)[0]
                    np.add.at(count[p], entry, 1)
                    np.add.at(total[p], entry, part)
        p, k = np.nonzero(count)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(count[p, k]), *(pa.array(total[p, k, j]) for j in range(width))], ["part", "entry", "n", *(f"x{j}" for j in range(width))])

    schema = "part int, entry int, n long, " + ", ".join(f"x{j} long" for j in range(width))
    sums = table.select("q").mapInArrow(add, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col(f"x{j}").cast("decimal(38,0)")).alias(f"x{j}") for j in range(width)))
    out = book.copy()
    for r in sums.collect():  # PARTS * ENTRIES rows at most
        out[r.part, r.entry] = [int(r[f"x{j}"]) // r.n for j in range(width)]
    return out


def assigned(table: DataFrame, book: np.ndarray, size: int) -> DataFrame:
    """vec_id, label, code, error by final codebooks."""
    width = size // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in book]
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                s = b.slice(i, ROWS)
                q = vectors(s, 2, size)
                entry, far = zip(*(c.nearest(q[:, p * width : (p + 1) * width])[:2] for p, c in enumerate(cells)))
                code = [x.tobytes().hex() for x in np.stack(entry, 1).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(code, pa.string()), pa.array(sum(far))], ["vec_id", "label", "code", "error"])

    return table.select("vec_id", "label", "q").mapInArrow(run, f"vec_id long, label {dict(table.dtypes)['label']}, code string, error long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle() -> str:
    """DuckDB SQL for the query's rows: a full search in each round."""
    steps = [
        f"v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, label, part, list_slice(q, part * (len(q) // {PARTS}) + 1, (part + 1) * (len(q) // {PARTS})) AS q FROM v, range({PARTS}) AS r(part))",
        f"b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, q FROM p QUALIFY entry < {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        near = f"SELECT p.vec_id, p.label, p.part, p.q, min(struct_pack(d := list_sum(list_transform(list_zip(p.q, b.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := b.entry)) AS best FROM p JOIN b{k} b USING (part) GROUP BY ALL"
        steps.append(f"a{k} AS MATERIALIZED ({near})")
        if k < ROUNDS:
            mean = f"SELECT part, entry, list(m ORDER BY j) AS q FROM (SELECT part, best.e AS entry, j, CAST((sum(q[j]) - (sum(q[j]) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM a{k}, LATERAL (SELECT unnest(range(1, len(q) + 1)) AS j) GROUP BY ALL) GROUP BY ALL"
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.q, b.q) AS q FROM b{k} b LEFT JOIN ({mean}) m USING (part, entry))")
    last = f"a{ROUNDS}"
    steps.append(f"c AS (SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM {last} GROUP BY ALL)")
    steps.append(f"s AS (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, s"


ORACLE = oracle()
