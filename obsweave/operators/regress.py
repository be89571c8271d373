"""Fits by grouped sums: least squares with many predictors, and robust lines."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import apart, held


def least_squares(df: DataFrame, keys: list[str], y: Column, xs: list[Column]) -> DataFrame:
    """keys, i, b: coefficients of y by the predictors, without an intercept; the shortest of equally good answers where predictors depend on each other.

    Sums of products are added up before any exchange, so a key costs a row of k * (k + 3) / 2 numbers a task, however many rows it has; the small systems are then solved many at a time, by Cholesky factors, or by
    eigenvalues where there are none."""
    k = len(xs)
    cols = [*xs, y]
    pairs = [(i, j) for i in range(k + 1) for j in range(i + 1) if j < k]
    named = df.select(*keys, *(c.cast("double").alias(f"v{i}") for i, c in enumerate(cols)))
    sums = named.groupBy(*keys).agg(*(F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"s{i}_{j}") for i, j in pairs))
    kinds = dict(sums.dtypes)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, v = np.zeros((b.num_rows, k, k)), np.zeros((b.num_rows, k))
            for i, j in pairs:
                s = np.asarray(b.column(f"s{i}_{j}").fill_null(0.0))
                if i < k:
                    g[:, i, j] = g[:, j, i] = s
                else:
                    v[:, j] = s
            at = pa.array(np.repeat(np.arange(b.num_rows), k))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in keys), pa.array(np.tile(np.arange(k), b.num_rows)), pa.array(solved(g, v).reshape(-1))], [*keys, "i", "b"])

    return sums.mapInArrow(solve, ", ".join([*(f"{c} {kinds[c]}" for c in keys), "i long", "b double"]))


def solved(g: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Solutions of n symmetric systems g x = v of size k."""
    size = np.sqrt(np.maximum(np.diagonal(g, axis1=1, axis2=2), 0))
    size = np.where(size > 0, size, 1.0)
    scaled, right = g / (size[:, :, None] * size[:, None, :]), v / size
    sound = np.linalg.eigvalsh(scaled)[:, 0] > 1e-10 if len(g) else np.zeros(0, bool)
    out = np.zeros_like(v)
    if sound.any():
        low = np.linalg.cholesky(scaled[sound])
        half = np.linalg.solve(low, right[sound][:, :, None])
        out[sound] = np.linalg.solve(low.transpose(0, 2, 1), half)[:, :, 0] / size[sound]
    if not sound.all():  # of least length in the units that were given
        out[~sound] = (np.linalg.pinv(g[~sound], rcond=1e-10, hermitian=True) @ v[~sound][:, :, None])[:, :, 0]
    return out


def robust_lines(df: DataFrame, keys: list[str], t: str, y: str, bound: float, rounds: int = 6) -> DataFrame:
    """keys, slope, level (at the keys' mean time), inside (the share of rows within `bound` of the line): a line through each key's rows by Huber weights. Rows count fully while they lie within `bound` of the line of the round before, and by
    bound / distance beyond. A round adds up weighted sums a key and joins them back; keys with fewer than two times have none."""
    rows = held(df.select(*keys, F.col(t).cast("double").alias("t_"), F.col(y).cast("double").alias("y_")).where("t_ IS NOT NULL AND y_ IS NOT NULL"))
    mean = held(rows.groupBy(*keys).agg(F.avg("t_").alias("m_")))
    line = None
    for _ in range(rounds + 1):
        r = rows.join(apart(mean), keys).withColumn("d_", F.col("t_") - F.col("m_"))
        if line is None:
            r = r.withColumn("w_", F.lit(1.0))
        else:
            off = F.abs(F.col("y_") - F.col("level") - F.col("slope") * F.col("d_"))
            r = r.join(apart(line), keys).withColumn("w_", F.when(off <= bound, 1.0).otherwise(bound / off))
        w, d, v = F.col("w_"), F.col("d_"), F.col("y_")
        s = r.groupBy(*keys).agg(F.sum(w).alias("n"), F.sum(w * d).alias("d"), F.sum(w * v).alias("v"), F.sum(w * d * d).alias("dd"), F.sum(w * d * v).alias("dv"))
        slope = (F.col("n") * F.col("dv") - F.col("d") * F.col("v")) / (F.col("n") * F.col("dd") - F.col("d") * F.col("d"))
        line = held(s.where("n * dd - d * d > 1e-9 * n * n").withColumn("slope", slope).select(*keys, "slope", ((F.col("v") - F.col("slope") * F.col("d")) / F.col("n")).alias("level")))
    met = rows.join(apart(mean), keys).join(apart(line), keys)
    inside = F.avg(F.when(F.abs(F.col("y_") - F.col("level") - F.col("slope") * (F.col("t_") - F.col("m_"))) <= bound, 1.0).otherwise(0.0))
    return met.groupBy(*keys).agg(F.first("slope").alias("slope"), F.first("level").alias("level"), inside.alias("inside"))
