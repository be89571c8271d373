"""The registered queries on the given tables against their contracts, and the pipeline's stages on awkward tables."""
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsweave.llm import bpe, brown, exact, huffman, jaccard, mixing, quality, registry, suffix, toxicity
from obsweave.llm.tokens import WordEncoder, default_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def sources(spark):
    return {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()}


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def crc(i, mod):
    return zlib.crc32(str(i).encode()) % mod


def test_every_operator_has_a_query():
    assert [q.split("_")[0] for q in registry.QUERIES] == [f"op{k}" for k in range(1, 14)]


def test_op1(spark, texts):
    rows = registry.QUERIES["op1_huffman_token_file"](spark, SF).collect()
    enc, start = WordEncoder.get(default_path()).tokenizer, 0
    got = {r.doc_id: r for r in rows}
    assert sorted(got) == sorted(texts) and len(rows) == len(texts)
    for i in sorted(texts):
        ids = np.array([*enc.encode(texts[i], add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op2(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = registry.QUERIES["op2_nearest_url_extraction"](spark, SF).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)
        body = pages[r.page_id].html
        assert not re.search(r"<(p|div|nav|article|b|br)\b", r.text) and r.text == "\n".join(x for x in (" ".join(y.split()) for y in r.text.split("\n")) if x)
        assert "track(" not in r.text and "middot" not in r.text and (r.text or not body)


def test_op3(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    rows = registry.QUERIES["op3_brown_class_scores"](spark, d).collect()
    n = collections.Counter()
    for i, t in texts.items():
        if crc(i, 7) != 2:
            n.update([*words(low(t)), ""])
    total, kinds = sum(n.values()), len(n)
    gain = collections.Counter()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        toks = [*words(low(texts[r.doc_id])), ""]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id, 7) == 2, len(toks), sum(n[x] > 0 for x in toks), total)
        assert abs(r.base_score - sum(np.log10((n[x] + 1) / (total + kinds + 1)) for x in toks)) < 1e-6
        gain[r.held_out] += r.score - r.base_score
    assert gain[False] > 0 and gain[True] > 0  # classes say more than single words do, of texts not learned from too


def test_op3_where_the_end_is_rare(spark, monkeypatch):
    monkeypatch.setattr(brown, "HEAD", 100)
    monkeypatch.setattr(brown, "CORE", 20)
    docs = spark.createDataFrame([(1, " ".join(f"w{k} w{k}" for k in range(200)))], "doc_id long, text string")
    (r,) = brown.score(docs, brown.learn(docs, brown.count_words(docs))).collect()
    want = 400 * np.log10(3 / (401 + 201 + 1)) + np.log10(2 / (401 + 201 + 1))
    assert (r.n_tokens, r.n_known, r.train_tokens) == (401, 401, 401) and abs(r.base_score - want) < 1e-6


def test_op5(spark, texts):
    rows = registry.QUERIES["op5_boosted_quality"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        t = texts[r.doc_id]
        w = words(t)
        grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (r.base_failed and r.kept)


def test_op7(spark, texts):
    rows = registry.QUERIES["op7_toxicity_grammar"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.held_out == (crc(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_op7_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    found = collections.Counter((labels[r.doc_id], r.predicted) for r in registry.QUERIES["op7_toxicity_grammar"](spark, d).collect() if r.held_out and r.doc_id in labels)
    assert found[1, 1] >= 0.8 * (found[1, 0] + found[1, 1]) and found[0, 1] <= 0.02 * (found[0, 0] + found[0, 1])


def test_op7_does_not_depend_on_how_rows_are_dealt(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    base = docs.select("doc_id", "text")
    got = [sorted((r.doc_id, round(r.score, 12)) for r in toxicity.score(base, toxicity.learn(base.repartition(n), labels.repartition(n))).collect()) for n in (2, 16)]
    assert got[0] == got[1]


def test_threats_need_a_target():
    t = toxicity.threat(3)

    def run(*symbols):
        state, out = 0, []
        for x in symbols:
            state, y = t(state, x)
            out.append(y)
        return out

    o, th, ta, end = toxicity.OTHER, toxicity.THREAT, toxicity.TARGET, toxicity.END
    assert run(th, o, o) == [0, 0, 0] and run(th, o, ta) == [0, 0, 1] and run(ta, o, o, th) == [0, 0, 0, 1] and run(ta, o, o, o, th) == [0] * 5
    assert run(th, o, o, o, ta) == [0] * 5 and run(th, end, ta) == [0, 0, 0] and run(ta, th, ta) == [0, 1, 0]


def test_op8(spark, texts, sources):
    rows = registry.QUERIES["op8_es_mixing"](spark, SF).collect()
    size = {i: len(words(t)) for i, t in texts.items()}
    by = collections.Counter()
    for i, s in sources.items():
        by[s] += size[i]
    goal = mixing.targets(dict(by))
    taken, largest = collections.Counter(), collections.Counter()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        s = sources[r.doc_id]
        assert (r["size"], r.source_size) == (size[r.doc_id], by[s]) and abs(r.target - float(goal[s])) < 1e-6 and 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
        largest[s] = max(largest[s], r["size"])
    for s in by:  # no further document brings a source nearer to its target
        assert abs(taken[s] - float(goal[s])) <= largest[s] / 2 + 1e-6
    assert abs(sum(map(float, goal.values())) - sum(by.values())) < 1e-6


def test_a_text_of_many_words(spark):
    """Whole texts, however long: 60,000 words beside short ones."""
    rng = np.random.default_rng(3)
    long = " ".join(f"w{k}" for k in rng.integers(0, 5000, 60_000))
    rows = [(1, long, "a"), (2, long + " more", "a"), (3, "short text of some words here", "b"), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    enc = WordEncoder.get(default_path()).tokenizer
    ids = enc.encode(long, add_special_tokens=False).ids
    got = {r.doc_id: r for r in bpe.encode(docs, digest=True).collect()}
    assert (got[1].n_tokens, got[1].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert {r.doc_id: r.n_tokens for r in huffman.read_ids(huffman.token_file(docs)).collect()}[1] == len(ids) + 1
    assert {r.doc_id: r.component_id for r in jaccard.link_components(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.doc_id for r in exact.dedup(docs).where("kept").collect()} == {1, 2, 3, 4}
    assert {r.doc_id: r.n_removed for r in suffix.repeats(docs).collect()} == {1: 0, 2: len(long), 3: 0, 4: 0}
    assert {r.doc_id: r["size"] for r in mixing.mix(docs).collect()} == {1: 60_000, 2: 60_001, 3: 6, 4: 0}
    base = docs.select("doc_id", "text")
    assert {r.doc_id: r.n_tokens for r in brown.score(base, brown.learn(base, brown.count_words(base))).collect()} == {1: 60_001, 2: 60_002, 3: 7, 4: 1}
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    assert {r.doc_id: r.n_words for r in quality.judge(docs, quality.fit(base, labels)).collect()} == {1: 60_000, 2: 60_001, 3: 6, 4: 0}
    toxic = toxicity.learn(base, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score(docs, toxic).collect()} == {0}


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, times int, time_ int, row_ long, `of` int, `Row` string"


def awkward(spark):
    body = lambda k: " ".join(f"{w}{k}" for w in "one two three four five six seven eight nine ten".split())
    rows = [(1, body(1), "a"), (1, body(1), "a"), (2, body(1).replace(" ", "  "), "b"), (3, body(3), None), (3, body(4), "a"), (None, body(5), "b"), (None, body(5), "b"), (None, body(6), "b"), (7, None, "a"), (8, "", "a"), (9, body(9), "b"), (10, body(9) + " end", "b"), (11, "you stupid idiot. you worthless moron. you pathetic scum", "a")]
    return spark.createDataFrame([(i, t, "x", s, len(t or ""), 5, 6, 100 + k, 1, "r") for k, (i, t, s) in enumerate(rows)], AWKWARD)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("awkward"))
    docs = awkward(spark)
    docs.write.parquet(f"{d}/documents.parquet")
    docs.select("doc_id", F.lit(0).alias("quality"), (F.col("doc_id") == 11).cast("int").alias("toxic")).where("doc_id IS NOT NULL").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_on_awkward_tables(spark, folder):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    empty = spark.createDataFrame([], docs.schema)
    for name, f in cp.STAGES:
        out = f(spark, empty, folder)
        assert out.collect() == [] and (f is cp.encode or out.columns == docs.columns), name
    kept = cp.drop_toxic(spark, docs, folder)
    assert kept.columns == docs.columns and sorted(r.row_ for r in kept.collect()) == list(range(100, 112))
    # equal texts: most code points stay, then the least id (null last), then one row; columns keep their values
    got = cp.drop_copies(spark, docs, folder).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter([2, 3, 3, None, None, 7, 9, 10, 11]) and {(r.times, r.time_, r.of, r.Row) for r in got} == {(5, 6, 1, "r")}
    assert {r.row_ for r in got} <= set(range(100, 113)) and len({r.row_ for r in got}) == len(got)
    # near copies: one row of a component; rows that share an id alone, or have no text, stay
    got = cp.drop_near_copies(spark, docs, folder).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter([1, 3, 3, None, None, 7, 8, 9, 11])
    assert cp.drop_near_copies(spark, docs, folder).columns == docs.columns
    mixed = cp.mix_sources(spark, docs, folder)
    rows = mixed.collect()
    assert mixed.columns == docs.columns and rows and not any(r.doc_id in (7, 8) for r in rows) and {(r.times, r.time_, r.of) for r in rows} == {(5, 6, 1)}
    assert max(collections.Counter(r.row_ for r in rows).values()) <= 3
    assert len(cp.encode(spark, docs, folder).collect()) == docs.count()
