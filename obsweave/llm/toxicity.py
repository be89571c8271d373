"""Toxicity by a weighted finite-state pattern grammar.

A lexicon maps words to classes: insult and threat (with a weight), target, negation, reported speech, other. Over a clause's classes run five
transducers - insult, threat with its target, target nearby, negation, reported speech - composed into one automaton; it emits what it accepts with the
context that stands around it, and the weight of a match is that of its pattern plus that of its context. A document is scored on its matched clauses: a clause
counts once, by its best match. An insult without a target is a match too, with the weight of that context: in the given tables toxic texts name no target.

What insults is learned: whole words and word beginnings whose document frequency among labelled toxic documents stands out
against chance, next to a short fixed lexicon; context weights and the final calibration are learned too, from at most
MAX_TRAIN labelled rows, which bounds the patterns too. Labels, language, source and doc_id are no inputs of a score."""
from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, text_slices
from .quality import sample

MAX_TRAIN = 12_000
STEM = (3, 10)  # lengths of word beginnings, in characters
#: A lexicon to start from, by class.
SEEDS = {
    "insult": "idiot idiots moron morons stupid loser losers trash scum pathetic worthless disgusting clown clowns dumb imbecile bastard".split(),
    "threat": "kill killing hurt destroy murder strangle stab shoot".split(),
    "target": "you your yours he she they him her them people everyone tu vous toi du dich ihr euch usted ustedes ellos".split(),
    "negation": "not never no without isn't aren't wasn't don't doesn't ne pas jamais nicht kein keine nie nunca jamás".split(),
    "reported": "said says claimed wrote quoted reported according dit disait selon sagte schrieb laut dijo según".split(),
}
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORTED, END = range(7)
CLASS = {"insult": INSULT, "threat": THREAT, "target": TARGET, "negation": NEGATION, "reported": REPORTED}
SEED_WEIGHT = 3.0
TRIM = b".,;:!?\"'()[]{}|*#-_<>"
NEGATION_REACH, TARGET_REACH = 3, 5  # words


class Transducer:
    """Deterministic: step[state][symbol] is (next state, output)."""

    def __init__(self, states: int, step: dict[tuple[int, int], tuple[int, int]]):
        self.states, self.step = states, step

    def __call__(self, state: int, symbol: int) -> tuple[int, int]:
        return self.step[state, symbol]


def reach(symbol: int, length: int | None) -> Transducer:
    """Outputs 1 while one of the last `length` symbols of the clause was `symbol` (None: any before)."""
    top = 1 if length is None else length
    step = {}
    for s, x in product(range(top + 1), range(7)):
        out = int(s > 0)
        nxt = 0 if x == END else top if x == symbol else s if length is None else max(0, s - 1)
        step[s, x] = (nxt, out)
    return Transducer(top + 1, step)


def insult() -> Transducer:
    """Outputs 1 at an insult."""
    return Transducer(1, {(0, x): (0, int(x == INSULT)) for x in range(7)})


def threat(length: int) -> Transducer:
    """Outputs 1 at a threat that follows a target, and at a target that follows a threat, at most `length` symbols apart. States: since neither, since a target, since a threat."""
    step = {}
    for s, x in product(range(2 * length + 1), range(7)):
        since_target, since_threat = (s if s <= length else 0), (s - length if s > length else 0)
        if x == END:
            step[s, x] = 0, 0
        elif x == TARGET:
            step[s, x] = length, int(since_threat > 0)
        elif x == THREAT:
            step[s, x] = (s - 1 if since_target else 2 * length), int(since_target > 0)
        else:
            step[s, x] = (0 if s in (0, 1, length + 1) else s - 1), 0
    return Transducer(2 * length + 1, step)


def compose(parts: list[Transducer]) -> Transducer:
    """Runs the parts side by side over the same classes; the output has one bit for each part."""
    spans = [p.states for p in parts]
    number = {c: k for k, c in enumerate(product(*map(range, spans)))}
    step = {}
    for c, x in product(number, range(7)):
        moves = [p(s, x) for p, s in zip(parts, c)]
        step[number[c], x] = (number[tuple(m[0] for m in moves)], sum(m[1] << k for k, m in enumerate(moves)))
    return Transducer(len(number), step)


#: Bits of an output: 1 target nearby, 2 negated, 4 reported: the context; 8 an insult, 16 a threat and its target.
GRAMMAR = compose([reach(TARGET, TARGET_REACH), reach(NEGATION, NEGATION_REACH), reach(REPORTED, None), insult(), threat(TARGET_REACH)])
CONTEXT, IS_INSULT, IS_THREAT = 7, 8, 16


class Lexicon(dict):
    """word (bytes, lower case) -> None, or (class, weight, ends a clause); a bounded memo over the patterns."""

    def __init__(self, words: dict[str, tuple[int, float]], stems: dict[str, float]):
        super().__init__()
        self.words, self.stems = words, stems
        self.lengths = sorted({len(s) for s in stems})

    def __reduce__(self):
        return Lexicon, (self.words, self.stems)

    def __missing__(self, raw: bytes):
        text = raw.strip(TRIM).decode("utf-8", "replace").lower()
        ends = raw[-1:] in b".!?;"
        got = self.words.get(text)
        if got is None:
            for n in self.lengths:
                if len(text) > n and (w := self.stems.get(text[:n])) is not None:
                    got = (INSULT, w) if got is None or w > got[1] else got
        out = (*got, ends) if got else (OTHER, 0.0, True) if ends else None
        if len(self) > 300_000:
            self.clear()
        self[raw] = out
        return out


def matches(text: bytes, lexicon: Lexicon) -> list[tuple[int, float, int]]:
    """(clause, pattern weight, context) of every insult, and every threat with its target, that the grammar accepts in a text. Lines and full stops end clauses."""
    out: list[tuple[int, float, int]] = []
    look, clause = lexicon.__getitem__, 0
    for line in text.lower().split(b"\n"):
        found = list(map(look, line.split()))
        hits = [k for k, f in enumerate(found) if f]
        if any(found[k][0] in (INSULT, THREAT) for k in hits):
            state, last, threatened = 0, -1, 0.0
            for k in hits:
                kind, weight, ends = found[k]
                for _ in range(min(k - last - 1, TARGET_REACH)):  # words of no class age what stands before them
                    state, _ = GRAMMAR(state, OTHER)
                state, got = GRAMMAR(state, kind)
                if kind == THREAT:
                    threatened = weight
                if got & IS_INSULT:
                    out.append((clause, weight, got & CONTEXT))
                if got & IS_THREAT:
                    out.append((clause, threatened, got & CONTEXT | 1))
                last = k
                if ends:
                    state, _ = GRAMMAR(state, END)
                    clause += 1
        clause += 1
    return out


def evidence(found: list[tuple[int, float, int]], context: np.ndarray) -> tuple[float, float, float]:
    """Of a document: the best clause, the sum over clauses (a clause counts by its best match), and the log of the number of clauses."""
    best: dict[int, float] = {}
    for clause, weight, c in found:
        w = weight + context[c]
        if w > best.get(clause, 0.0):
            best[clause] = w
    if not best:
        return 0.0, 0.0, 0.0
    return max(best.values()), sum(best.values()), math.log1p(len(best))


class Model:
    def __init__(self, lexicon: Lexicon, context: np.ndarray, weights: np.ndarray):
        self.lexicon, self.context, self.weights = lexicon, context, weights

    def score(self, text: bytes) -> float:
        x = evidence(matches(text, self.lexicon), self.context)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.weights[0] + sum(w * v for w, v in zip(self.weights[1:], x))))))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """text, y: one row of each label and text, told apart by a digest of the lower-case words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = [hashlib.sha256(b" ".join((t or "").lower().encode().split())).digest() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(marks, pa.binary())], ["text", "y", "mark"])

    return rows.select("text", "y").mapInArrow(run, "text string, y int, mark binary").groupBy("mark", "y").agg(F.min("text").alias("text")).select("text", "y")


def pattern_counts(rows: DataFrame) -> DataFrame:
    """pattern, toxic, clean: in how many labelled documents (doc_id, text, y) each word and word beginning occurs. Equal texts of one label count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = (Counter(), Counter())
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                kinds = {w.strip(TRIM).decode("utf-8", "replace") for w in (text or "").lower().encode().split()} - {""}
                stems = {w[:n] + "*" for w in kinds for n in range(STEM[0], min(STEM[1], len(w) - 1) + 1)}
                counts[bool(y)].update(kinds | stems)
            names = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][n] for n in names], pa.int64()), pa.array([counts[0][n] for n in names], pa.int64())], ["pattern", "toxic", "clean"])

    return distinct_texts(rows).mapInArrow(run, "pattern string, toxic long, clean long").groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def contexts(rows: DataFrame, patterns: set[str]) -> DataFrame:
    """pattern, n: between how many different pairs of neighbours the patterns occur."""
    shared = rows.sparkSession.sparkContext.broadcast(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            met = set()
            for text in b.column(1).to_pylist():
                words = ["", *(w.strip(TRIM).decode("utf-8", "replace") for w in (text or "").lower().encode().split()), ""]
                for i in range(1, len(words) - 1):
                    w = words[i]
                    for p in (w, *(w[:n] + "*" for n in range(STEM[0], min(STEM[1], len(w) - 1) + 1))):
                        if p in known:
                            met.add((p, zlib.crc32(f"{words[i - 1]} {words[i + 1]}".encode())))
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in met], pa.string()), pa.array([m[1] for m in met], pa.int64())], ["pattern", "place"])

    return rows.select("doc_id", "text").mapInArrow(run, "pattern string, place long").distinct().groupBy("pattern").agg(F.count("*").alias("n"))


def learn(docs: DataFrame, labels: DataFrame, keep=None, most: int = MAX_TRAIN) -> Model:
    """A model from at most `most` labelled rows that satisfy `keep`. Without labels of both kinds the fixed lexicon alone decides."""
    picked = sample(labels, "toxic", most, keep)
    rows = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y").repartition(picked.sparkSession.sparkContext.defaultParallelism, "doc_id").persist()
    totals = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    words = {w: (CLASS[k], 0.0 if k not in ("insult", "threat") else SEED_WEIGHT) for k, ws in SEEDS.items() for w in ws}
    stems: dict[str, float] = {}
    if bad and good:
        odds = F.log((F.col("toxic") + 0.5) / (bad + 1.0)) - F.log((F.col("clean") + 0.5) / (good + 1.0))
        found = pattern_counts(rows).withColumn("odds", odds).where((F.col("toxic") >= 3) & (F.col("odds") > 3.2)).orderBy("pattern").collect()
        around = {r.pattern: r.n for r in contexts(rows.where("y = 1"), {r.pattern for r in found}).collect()}
        # chance: that so many places all happen to be in toxic documents. Copies of a passage are one place; further places in one document count half
        unlikely = lambda r, n: (min(r.toxic, n) + 0.5 * max(0, n - r.toxic)) * -math.log(bad / (bad + good)) > 12
        got = {r.pattern: r for r in found if (n := around.get(r.pattern, 0)) >= 0.5 * r.toxic and unlikely(r, n)}
        for p, r in got.items():
            if p.endswith("*"):
                # the longest beginning that loses few of the documents of the shorter ones, so that it takes in little else
                if not any(len(q) > len(p) and q.startswith(p[:-1]) and q.endswith("*") and s.toxic > 0.9 * r.toxic for q, s in got.items()):
                    if not any(len(q) < len(p) and p.startswith(q[:-1]) and q.endswith("*") and s.odds >= r.odds - 0.5 and s.toxic > r.toxic for q, s in got.items()):
                        if not any(not q.endswith("*") and q.startswith(p[:-1]) and s.toxic > 0.8 * r.toxic for q, s in got.items()):  # more than one word's
                            stems[p[:-1]] = min(r.odds, 6.0)
            elif words.get(p, (INSULT,))[0] in (INSULT, THREAT):
                words[p] = (words.get(p, (INSULT,))[0], min(r.odds, 6.0))
    lexicon = Lexicon(words, stems)
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [matches((t or "").encode(), shared.value) for t in b.column(1).to_pylist()]
            flat = [pa.array([[x[k] for x in g] for g in got], pa.list_(t)) for k, t in ((0, pa.int32()), (1, pa.float64()), (2, pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *flat], ["doc_id", "y", "clause", "weight", "context"])

    table = rows.mapInArrow(match, "doc_id long, y int, clause array<int>, weight array<double>, context array<int>").orderBy("doc_id").collect()
    rows.unpersist()
    context = np.zeros(8)
    n = np.zeros((8, 2))
    for r in table:
        for c in set(r.context):
            n[c, r.y] += 1
    if bad and good:
        for c in range(8):  # relative to matches in no context; shrunk where there are few
            plain = math.log((n[0, 1] + 1) / (n[0, 0] + 1))
            context[c] = float(np.clip(math.log((n[c, 1] + 1) / (n[c, 0] + 1)) - plain, -3, 3)) * (n[c].sum() / (n[c].sum() + 25)) if c else 0.0
    prior = {1: 0.5, 2: -1.5, 4: -1.5}  # where labels don't tell
    for c in range(1, 8):
        context[c] += sum(v for k, v in prior.items() if c & k) * 25 / (n[c].sum() + 25)
    x = np.array([evidence(list(zip(r.clause, r.weight, r.context)), context) for r in table], np.float64).reshape(-1, 3)
    return Model(lexicon, context, calibrate(x, np.array([r.y for r in table], np.float64)))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method around a prior that asks for clear evidence; coefficients stay at 0 or above."""
    prior = np.array([-4.0, 0.8, 0.4, 0.5])
    if len(np.unique(y)) < 2:
        return prior
    a = np.hstack([np.ones((len(x), 1)), x])
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge * (w - prior)
        hess = (a * (p * (1 - p))[:, None]).T @ a + (ridge + 1e-6) * np.eye(4)
        move = np.linalg.solve(hess, grad)
        w = w - move / max(1.0, np.abs(move).max())
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(move).max() < 1e-6:
            break
    return w


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted of every document. Null texts count as empty and score by the calibration's constant. A score depends on the text alone: repeated
    rows have the same, a null doc_id changes nothing; an empty table gives no rows, further columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text_slices(batches):
            s = np.array([shared.value.score(x) for x in t.blobs()], np.float64)
            yield pa.RecordBatch.from_arrays([t.id_array(), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs, all columns, without the documents that score `threshold` or more. Null texts stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [t is None or shared.value.score(t.encode()) < threshold for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, learn(id_text(docs), labels, ~held_out())).select("doc_id", held_out().alias("held_out"), "score", "predicted")
