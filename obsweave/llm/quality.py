"""Quality rules: gradient-boosted trees over document statistics, flattened into numpy arrays for vectorised
scoring, with monotonic constraints.

The trees are fitted on a sample of labelled rows of at most MAX_TRAIN documents; statistics and scores cover every
whole text."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Texts, id_text, text_slices, word_bounds

MAX_TRAIN = 20_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_kinds", "n_stops", "n_capitals", "n_digits")
#: Features of the trees, and the direction a score may move in as each grows: -1 down, 1 up, 0 either.
FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "kind_share", "stop_share", "capital_share", "digit_share")
MONOTONE = (0, 0, -1, -1, -1, 0, 0, 0, 0)


def repeated_words(words: list[bytes], width: int = 5) -> tuple[int, int]:
    """Words inside windows of `width` words that occur twice or more, and the number of different words. Windows are compared
    exactly: they are numbered by the numbers of their words."""
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    n, kinds = len(ids) - width + 1, len(names)
    if n < 2 or len(ids) == kinds:
        return 0, kinds
    key, top = ids[:n].copy(), kinds
    for k in range(1, width):
        if top >= (1 << 62) // kinds:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            top = int(key.max()) + 1
        key = key * kinds + ids[k : k + n]
        top *= kinds
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0, kinds
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(hit)
    edge[at] += 1
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum()), kinds


def stats(t: Texts) -> np.ndarray:
    """STATS of each text, one row for each."""
    s, _, n = word_bounds(t)
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[t.off])
    rows = [(*repeated_words(ws := x.split()), *_lines(x), sum(map(ws.count, STOPS)) if len(ws) < 40 else _stops(ws)) for x in t.blobs()]
    per = np.array(rows, np.int64).reshape(-1, 5)
    b = t.buf
    return np.stack([n, total(((b & 0xC0) != 0x80) & ~SPACE[b]), total(SYMBOLS[b]), per[:, 3], per[:, 0], per[:, 2], per[:, 1], per[:, 4], total((b >= 65) & (b <= 90)), total((b >= 48) & (b <= 57))], 1).astype(np.int64)


#: Frequent words that running text of four languages has, any of which few lists and tables have.
STOPS = (b"the", b"of", b"and", b"to", b"in", b"is", b"de", b"la", b"et", b"les", b"que", b"el", b"y", b"der", b"die", b"und", b"den")
_STOP_SET = frozenset(STOPS)


def _stops(words: list[bytes]) -> int:
    return sum(map(_STOP_SET.__contains__, words))


def _lines(text: bytes) -> tuple[int, int]:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def features(s: np.ndarray) -> np.ndarray:
    v = dict(zip(STATS, s.astype(np.float64).T))
    words, chars, lines = np.maximum(v["n_words"], 1), np.maximum(v["word_chars"], 1), np.maximum(v["n_lines"], 1)
    return np.stack([np.log1p(v["n_words"]), v["word_chars"] / words, v["n_symbols"] / chars, v["n_dup_lines"] / lines, v["n_repeat_words"] / words, v["n_kinds"] / words, v["n_stops"] / words, v["n_capitals"] / chars, v["n_digits"] / chars], 1)


class Trees:
    """Boosted trees of logistic loss as flat arrays: node i tests x[feature[i]] <= cut[i] and goes to left[i] or right[i]; a leaf
    has feature -1 and adds value[i]."""

    def __init__(self, start: float, roots: list[int], nodes: list[tuple[int, float, int, int, float]]):
        cols = list(zip(*nodes)) or [(), (), (), (), ()]
        self.start, self.roots = start, np.array(roots, np.int64)
        self.feature, self.left, self.right = (np.array(cols[k], np.int64) for k in (0, 2, 3))
        self.cut, self.value = np.array(cols[1], np.float64), np.array(cols[4], np.float64)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.feature[at] >= 0).any():
                a = at[inner]
                at[inner] = np.where(x[rows[inner], self.feature[a]] <= self.cut[a], self.left[a], self.right[a])
            out += self.value[at]
        return 1 / (1 + np.exp(-out))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...] = (), trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, shrink: float = 1.0) -> Trees:
        """Histogram splits on quantile bins. For a constrained feature, a split must order its children's values, and each child's
        values are held on its side of their middle, so that the constraint holds for whole trees."""
        monotone = monotone or (0,) * x.shape[1]
        rate_pos = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        start = float(np.log(rate_pos / (1 - rate_pos)))
        if len(np.unique(y)) < 2:
            return cls(start, [], [])
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        code = np.stack([np.searchsorted(q, c) for q, c in zip(cuts, x.T)], 1)
        raw, roots, nodes = np.full(len(y), start), [], []

        def leaf(g: float, h: float, low: float, high: float) -> float:
            return float(np.clip(-g / (h + shrink), low, high))

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
            at = len(nodes)
            nodes.append(None)
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, None)
            for f, q in enumerate(cuts if level < depth and len(rows) >= 2 * least else ()):
                if not len(q):
                    continue
                c = code[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(c, w, len(q) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                gain = gl**2 / (hl + shrink) + (gs - gl) ** 2 / (hs - hl + shrink) - gs**2 / (hs + shrink)
                vl, vr = np.clip(-gl / (hl + shrink), low, high), np.clip(-(gs - gl) / (hs - hl + shrink), low, high)
                bad = (nl < least) | (len(rows) - nl < least) | (monotone[f] * (vr - vl) < 0)
                gain[bad] = -np.inf
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, k, vl[k], vr[k]))
            if best[1] is None:
                v = rate * leaf(gs, hs, low, high)
                nodes[at] = (-1, 0.0, 0, 0, v)
                raw[rows] += v
                return at
            f, k, vl, vr = best[1]
            mid = (vl + vr) / 2
            lo, hi = (low, mid), (mid, high)
            if monotone[f] == 0:
                lo = hi = (low, high)
            elif monotone[f] < 0:
                lo, hi = hi, lo
            goes = code[rows, f] <= k
            a = grow(rows[goes], g, h, level + 1, *lo)
            b = grow(rows[~goes], g, h, level + 1, *hi)
            nodes[at] = (f, float(cuts[f][k]), a, b, 0.0)
            return at

        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        return cls(start, roots, nodes)


def stats_table(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text_slices(batches):
            yield pa.RecordBatch.from_arrays([t.id_array(), *(pa.array(c) for c in stats(t).T)], ["doc_id", *STATS])

    return docs.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in STATS))


def sample(labels: DataFrame, column: str, most: int, keep=None) -> DataFrame:
    """At most `most` labelled rows (doc_id, y), the first by a hash of doc_id; one label for each doc_id."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).dropna()
    rows = rows.where(keep) if keep is not None else rows
    return rows.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Trees:
    """Trees from at most `most` labelled documents; without labels of both kinds, a constant."""
    picked = sample(labels, "quality", most)
    rows = stats_table(docs.join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi")).join(picked, "doc_id").orderBy("doc_id").toPandas()
    return Trees.fit(features(rows[list(STATS)].to_numpy()), rows["y"].to_numpy(), MONOTONE)


def judge(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """STATS, base_failed, score and kept of every document.

    Null and empty texts have no words and fail the base rule. Rows are judged one by one, whatever repeats or has no doc_id."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text_slices(batches):
            s = stats(t)
            n, rep = s[:, 0], s[:, 4]
            failed = (n < 10) | (100 * rep > 20 * n)
            score = shared.value.score(features(s))
            yield pa.RecordBatch.from_arrays([t.id_array(), *(pa.array(c) for c in s.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= least))], ["doc_id", *STATS, "base_failed", "score", "kept"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in STATS) + ", base_failed boolean, score double, kept boolean"
    return id_text(docs, id_col, text_col).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(docs, fit(id_text(docs), labels)).select("doc_id", *STATS[:5], "base_failed", "kept", "score")
