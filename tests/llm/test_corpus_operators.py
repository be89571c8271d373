"""The corpus operators against brute force, on documents with nulls, empty texts, ties, repeated rows and clashing column names."""
import collections
import hashlib
import re
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest

from obsweave.llm import bpe, brown, exact, html, huffman, jaccard, mixing, quality, suffix, toxicity
from obsweave.llm.common import splitmix
from obsweave.llm.tokens import WordEncoder, default_path

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron Ünïcode don't 3x7 x. y,".split()


def text(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[k] for k in rng.integers(0, len(WORDS), n))


LONG = text(1, 400)
DOCS = [
    (1, LONG), (2, LONG), (3, LONG + " one more"), (4, None), (5, ""), (6, " \n\t"), (7, "only three words"), (8, "only three\nwords"),
    (9, text(2, 60)), (10, text(2, 60) + " end"), (11, "İstanbul ́é 日本 <|endoftext|> \x85 z"), (12, text(3, 3000)), (13, text(4, 30) + LONG[:300]), (13, text(4, 30) + LONG[:300]), (None, text(9, 50)), (15, "a"),
]
SCHEMA = "doc_id long, text string, source string, ids string, row long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None if k % 5 == 0 else f"s{k % 3}", "clash", k) for k, (i, t) in enumerate(DOCS)], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_token_file_that_stays(spark, docs, tmp_path):
    huffman.token_file(docs, to=str(tmp_path / "ids"))
    kept = spark.read.parquet(str(tmp_path / "ids"))
    assert sorted(map(tuple, huffman.read_ids(kept).collect()), key=str) == sorted(map(tuple, huffman.read_ids(huffman.token_file(docs)).collect()), key=str)


def test_token_files(docs, empty):
    enc = WordEncoder.get(default_path()).tokenizer
    start, want = 0, []
    for i, t in sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = np.array([*enc.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, huffman.read_ids(huffman.token_file(docs)).collect()), key=str) == sorted(want, key=str)
    assert huffman.read_ids(huffman.token_file(empty)).collect() == []


def test_codes_are_limited_and_complete():
    rng = np.random.default_rng(0)
    for n, limit in ((1, 4), (2, 4), (16, 4), (300, 12)):
        counts = (rng.pareto(0.3, n) * 10).astype(np.int64) + 1
        lengths = huffman.code_lengths(counts, limit)
        assert lengths.max() <= limit and sum(2.0 ** -int(x) for x in lengths) <= 1
        ids = rng.integers(0, n, 1000)
        block = huffman.encode_block([5, None], [ids[:10], ids[10:]], lengths, huffman.canonical(lengths)[0])
        assert np.array_equal(huffman.decode_block(block, huffman.decode_table(lengths, limit), limit)[3], ids)


def test_bpe(docs, empty):
    t = WordEncoder.get(default_path()).tokenizer
    want = []
    for i, x in DOCS:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.encode(docs, digest=True).collect()), key=str) == sorted(want, key=str)
    assert bpe.encode(empty).collect() == []


def test_joins_of_any_cuts():
    enc = WordEncoder.get(default_path())
    rng = np.random.default_rng(5)
    raw = (text(6, 80) + " ünï 日本語 ").encode()
    for _ in range(200):
        cuts = sorted({0, len(raw), *(c for c in rng.integers(0, len(raw), 6).tolist() if raw[c] & 0xC0 != 0x80)})
        parts = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        assert bpe.join_ids(parts, [enc.text(p) for p in parts], enc) == enc.text(raw)


def test_exact(docs, empty):
    groups = collections.defaultdict(list)
    for i, t in DOCS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    got = exact.dedup(docs).collect()
    assert len(got) == len(DOCS) and sum(r.kept for r in got) == len(groups)
    for r in got:
        norm, g = next((n, g) for n, g in groups.items() if hashlib.sha256(n.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(g) and r.keep_id == min(g, key=lambda d: (-len(d[1]), d[0] is None, d[0] or 0))[0]
    assert exact.dedup(empty).collect() == []


def test_jaccard(spark, docs, empty):
    fixed = [(k, text(100 + k % 4, 80) + f" tail{k // 4 % 6} more{k % 3}") for k in range(60)]
    for rows in (DOCS, fixed):
        sets = {}
        for i, t in rows:
            w = words(low(t))
            sets.setdefault(i, set()).update({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else ())
        up = {i: i for i in sets if i is not None}
        for a in up:
            for b in up:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    x, y = sorted((root(up, a), root(up, b)))
                    up[y] = x
        table = docs if rows is DOCS else spark.createDataFrame(rows, "doc_id long, text string")
        # components in one block; and dealt over blocks of a few sets, with hot shingles
        for limits in ({}, {"block": 2000, "hot": 64}):
            for r in jaccard.link_components(table, **limits).collect():
                assert r.doc_id is None or (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root(up, r.doc_id))
    assert jaccard.link_components(empty).collect() == []


def test_jaccard_slots():
    """A prefix has the lowest hashes of its set; its postings go to all slots alike, and more sets take more slots, not larger ones."""
    rng = np.random.default_rng(3)
    order = jaccard.Order([])
    token = jaccard.scattered(np.concatenate([order.prefix(np.unique(rng.integers(0, 2**64, 400, np.uint64)), 75) for _ in range(300)]))
    rows = np.zeros(len(token), jaccard.PLACED)
    rows["token"] = token
    batch = pa.RecordBatch.from_pydict({"gid": [1], "n": [400], "prefix": [rows.tobytes()], "sketch": [b""]})
    size = {r["slot"]: len(r["rows"]) // jaccard.POSTED.itemsize for out in jaccard.pack_postings(32, types.SimpleNamespace(value=order))([batch]) for r in out.to_pylist()}
    assert len(size) == 32 and max(size.values()) < 1.3 * len(token) / 32
    for sets in (1000, 10**6, 3 * 10**6, 10**8):
        s = jaccard.slots_for(sets, 73, 90)
        assert s >= 32 and sets * (73 * 16 / s + (1 - (1 - 1 / s) ** 73) * 106) <= jaccard.SLOT


def test_jaccard_sketches():
    import random

    rnd = random.Random(4)
    for n in (1, 5, 60, 700, 30_000):
        a = np.unique(np.array([rnd.getrandbits(64) for _ in range(n)], np.uint64))
        b = np.unique(np.concatenate([a[: n - n // 8], np.array([rnd.getrandbits(64) for _ in range(n // 9)], np.uint64)]))
        got = jaccard.Sketches([jaccard.sketch(x).tobytes() for x in (a, b)]).differ(np.array([0]), np.array([1]))[0]
        assert got <= len(np.setxor1d(a, b))


def root(up, i):
    while up[i] != i:
        i = up[i]
    return i


def test_repeated_strings(docs, empty):
    first = {}
    for i, t in DOCS:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], 2**63), 2**63 - 1 if i is None else i)
    want = []
    for i, t in DOCS:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < (2**63 - 1 if i is None else i):
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    assert sorted(map(tuple, suffix.repeats(docs).collect()), key=str) == sorted(want, key=str)
    assert suffix.repeats(empty).collect() == []


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert all(r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0) for r in got) and len(got) == len(DOCS)
    t = mixing.targets({"a": 100, "b": 1, None: 50})
    assert t["b"] == 3 and sum(t.values()) == 151
    assert mixing.mix(empty).collect() == []


def test_quality(docs, empty, spark):
    labels = spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int")
    trees = quality.fit(docs.select("doc_id", "text"), labels)
    for r in quality.judge(docs, trees).collect():
        n = [t for i, t in DOCS if i == r.doc_id][0]
        w = words(n)
        grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(cover))
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert quality.judge(empty, trees).collect() == []


def test_monotone_trees():
    rng = np.random.default_rng(7)
    x = rng.random((800, 3))
    y = (x[:, 0] + 0.3 * rng.random(800) - 0.2 * np.sin(9 * x[:, 1]) > 0.6).astype(int)
    m = quality.Trees.fit(x, y, (1, 0, -1))
    for row in x[:40]:
        up, down = np.repeat(row[None], 30, 0), np.repeat(row[None], 30, 0)
        up[:, 0], down[:, 2] = np.linspace(0, 1, 30), np.linspace(0, 1, 30)
        assert (np.diff(m.score(up)) >= -1e-12).all() and (np.diff(m.score(down)) <= 1e-12).all()
    assert ((m.score(x) > 0.5) == y).mean() > 0.85


def test_toxicity(spark, docs, empty):
    bad = [(k, f"the {text(k, 8)} you are a blarg{'abc'[k % 3]} {text(k + 50, 9)}", 1) for k in range(0, 90, 2)]
    good = [(k, text(k, 20), 0) for k in range(1, 400, 2)]
    rows = spark.createDataFrame(bad + good, "doc_id long, text string, toxic int")
    model = toxicity.learn(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    got = {r.doc_id: r.predicted for r in toxicity.score(rows, model).collect()}
    assert sum(got[k] for k, *_ in bad) >= 0.95 * len(bad) and not any(got[k] for k, *_ in good)
    assert {r.predicted for r in toxicity.score(docs, model).collect()} == {0}
    assert toxicity.score(empty, model).collect() == []
    plain = toxicity.learn(empty.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert plain.score(b"you are an idiot. you stupid loser. trash. you moron") > 0.7 > plain.score(b"nobody said that")


def test_toxicity_counts_each_text_once(spark):
    shared = "zz yy xx ww vv uu tt ss rr qq pp oo"  # a passage that different documents have
    rows = [(k, f"word{k} {shared}", k % 2) for k in range(6)] + [(10 + k, "Same  text again here now", 1) for k in range(4)] + [(20, "same text again here now", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    want = collections.defaultdict(lambda: [0, 0])
    for t, y in {(" ".join(t.lower().split()), y) for _, t, y in rows}:
        for w in set(t.split()):
            want[w][1 - y] += 1
    for parts in (1, 5):
        got = {r.pattern: [r.toxic, r.clean] for r in toxicity.pattern_counts(df.repartition(parts, "doc_id")).collect() if not r.pattern.endswith("*")}
        assert got == dict(want)


def test_brown(docs, empty):
    base = docs.select("doc_id", "text")
    w = brown.count_words(base)
    counts = collections.Counter(x for _, t in DOCS for x in [*words(low(t)), ""])
    n, v = sum(counts.values()), len(counts)
    got = brown.score(docs, brown.learn(base, w)).collect()
    want = collections.defaultdict(list)
    for i, t in DOCS:
        want[i].append(sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in [*words(low(t)), ""]))
    assert len(got) == len(DOCS)
    for r in got:
        assert r.train_tokens == n and r.n_known == r.n_tokens and abs(r.base_score - want[r.doc_id][0]) < 1e-6 and r.score < 0
    none = empty.select("doc_id", "text")
    assert brown.score(empty, brown.learn(none, brown.count_words(none))).collect() == []


def test_brown_classes_rare_words_by_their_neighbours(spark):
    rows = [(i, "\n".join(f"{p} w{j:04}{k}xyz {q}" for j in range(i * 300, i * 300 + 300))) for i in range(30) for k, p, q in (("k", "one", "two"), ("l", "red", "blue"))]
    base = spark.createDataFrame(rows, "doc_id long, text string")
    model = brown.learn(base, w := brown.count_words(base))
    tries = spark.createDataFrame([(k, f"{p} w8999{x}xyz {q}") for k, (p, x, q) in enumerate((("one", "k", "two"), ("one", "l", "two"), ("red", "l", "blue"), ("red", "k", "blue")))], "doc_id long, text string")
    got = {r.doc_id: r.score for r in brown.score(tries, model).collect()}
    assert got[0] > got[1] + 1 and got[2] > got[3] + 1


def test_brown_gains():
    rng = np.random.default_rng(4)
    grams = rng.poisson(0.3, (90, 90)).astype(float)
    cls = rng.integers(1, brown.CLASSES, 90)
    tabled = lambda c: np.array([[grams[c == i][:, c == j].sum() for j in range(brown.CLASSES)] for i in range(brown.CLASSES)])
    side = lambda x: np.array([np.bincount(cls, np.where(np.arange(90) == w, 0, x[w]), brown.CLASSES) for w in range(90)])
    got = brown.gains(tabled(cls), cls, side(grams.T), side(grams), np.diagonal(grams))
    for w in range(0, 90, 9):
        for b in (1, 7, 30):
            moved = cls.copy()
            moved[w] = b
            want = brown.likelihood(tabled(moved)) - brown.likelihood(tabled(cls))
            assert abs(got[w, b] - got[w, cls[w]] - want) < 1e-6


def test_html(spark):
    page = lambda own: f"<html><head><title>t</title></head><body><nav><a>Menu</a></nav><p>Welcome to the site</p><p>{own} &amp; <b>more</b></p><script>x='</p>'</script><div class='comments'>first!</div><p>All rights reserved</p></body></html>"
    rows = [(1, "http://h.com/a/1", page("one")), (2, "http://h.com/a/2", page("two")), (3, None, None), (4, "http://k.com/", "<article><h1>T</h1><p>a\n b</p></article><p>out</p>"), (5, "http://k.com/", "<article><h1>T</h1><p>a\n b</p></article><p>out</p>")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "one & more", 2: "two & more", 3: "", 4: "T\na b", 5: "T\na b"}
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_html_beside_an_article(spark):
    page = lambda own: f"<html><head><meta charset=utf-8><title>t</title><body><nav>Menu</nav><p>Welcome</p><div><p>{own} text</p></div><article><h2>Card</h2></article><section>{own} end</section><div class='ad'>{own} buy</div><p>Imprint</p></body></html>"
    rows = [(1, "http://h.com/a/1", page("one")), (2, "http://h.com/a/2", page("two")), (3, "http://k.com/", "<p>alone</p><article>own</article>")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "one text\nCard\none end", 2: "two text\nCard\ntwo end", 3: "alone\nown"}


def test_html_forms_of_markup():
    text = lambda page: [x for _, x in html.lines(page)]
    assert text("<html><head><meta charset=x><body><p>Hello world</p></body></html>") == ["Hello world"]
    assert text("<datalist><option>a<option>b</datalist><p>b</p><select><option>c</select><p>d</p>") == ["b", "d"]
    assert text("<p class='side-by-side'>a</p><div class='ad-hoc x'>b</div><div class='cookie-notice'>c</div><div id=site_header-2>d</div><div class='wide ad'>e</div><div class='user-comments'>f</div>") == ["a", "b"]
    assert text("<div><noscript><p>a</div><p>b</p>") == ["b"]
    assert len(text("<p>x</p>" * 100_000)) == 100_000


def test_common_lines_of_long_pages():
    a = [str(k % 977) for k in range(4000)]
    b = [str(k * 7 % 983) for k in range(4000)]
    got = html.common_lines(a, b)
    it = iter(b)
    assert all(a[k] in it for k in sorted(got)) and len(got) > 50
    assert html.common_lines(a, a) == set(range(4000))


def test_common_lines():
    rng = np.random.default_rng(8)
    for _ in range(200):
        a, b = ([str(x) for x in rng.integers(0, 4, rng.integers(0, 9))] for _ in "ab")
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        got = html.common_lines(a, b)
        assert len(got) == best[-1, -1]
        it = iter(b)
        assert all(a[k] in it for k in sorted(got))


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, d)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    enc = WordEncoder.get(default_path()).tokenizer
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = out.collect()
    assert 0 < len(rows)
    for r in rows[:50]:
        ids = enc.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def brute_pipeline(kept):
    """doc_id of every row that run() gives for (doc_id, text, source) after toxicity, with multiplicity."""
    groups = collections.defaultdict(list)
    for d in kept:
        groups[re.sub(r"[\x20\x09-\x0D]", "", d[1] or "")].append(d)
    rows = [min(g, key=lambda d: (-len(d[1] or ""), d[0])) for g in groups.values()]
    sets = {}
    for i, t, _ in rows:
        w = words(low(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up, where = {i: i for i in sets}, collections.defaultdict(set)
    for i, x in sets.items():
        for g in x:
            where[g].add(i)
    for a, x in sets.items():
        for b, n in collections.Counter(b for g in x for b in where[g] if b > a).items():
            if 100 * n >= 75 * (len(x) + len(sets[b]) - n):
                p, q = sorted((root(up, a), root(up, b)))
                up[q] = p
    rows = [d for d in rows if root(up, d[0]) == d[0]]
    by = collections.defaultdict(list)
    for i, t, s in rows:
        w = words(t)
        u = float(int(splitmix(np.uint64(i) ^ splitmix(np.array([8]))[0])) >> 11)
        by[s].append((-np.log((u + 0.5) / 2.0**53) / (0.25 + 0.75 * len(set(w)) / max(len(w), 1)), i, len(w)))
    goal = mixing.targets({s: sum(x[2] for x in g) for s, g in by.items()})
    out = collections.Counter()
    for s, g in by.items():
        size = sum(x[2] for x in g)
        epochs = goal[s] // size if size else 0
        budget, prior, once = goal[s] - epochs * size, 0, set()
        for _, i, n in sorted(g):
            prior += n
            if prior <= budget:
                once.add(i)
        rest = budget - sum(n for _, i, n in g if i in once)
        # what is left goes to the document that comes nearest to it
        more = [(abs(rest - n), key, i) for key, i, n in g if i not in once and 0 < n < 2 * rest]
        once |= {min(more)[2]} if more else set()
        for _, i, n in g:
            out[i] += (3 if epochs >= 3 else epochs + (i in once)) if n else 0
    return +out


@pytest.mark.parametrize("planted", [False, True])
def test_all_rows_of_the_pipeline(spark, tmp_path, planted):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    if planted:
        own = [(k, f"{text(500 + k, 60)} own{k} words{k} here{k}", f"s{k % 3}") for k in range(40)]
        near = [(100 + k, own[k][1] + " tail", "s1") for k in range(8)]
        same = [(200 + k, own[k + 20][1].replace(" ", "  "), "s2") for k in range(8)] + [(300, own[20][1], "s0")]
        bad = [(400 + k, f"you are a stupid idiot, {text(700 + k, 20)}. you are scum. you pathetic loser", "s0") for k in range(6)]
        d = str(tmp_path)
        rows = own + near + same + bad + [(500, "", "s0"), (501, None, "s1")]
        spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(x[0], 0, int(400 <= x[0] < 500)) for x in rows], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = [(r.doc_id, r.text, r.source) for r in corpus_pipeline.drop_toxic(spark, docs, d).collect()]
    if planted:
        assert {x[0] for x in rows} - {x[0] for x in kept} == {x[0] for x in bad}
    texts = {i: t for i, t, _ in kept}
    want = brute_pipeline(kept)
    assert 0 < len(want) < len(kept)
    enc = WordEncoder.get(default_path()).tokenizer
    rows = corpus_pipeline.run(spark, d).collect()
    assert collections.Counter(r.doc_id for r in rows) == want
    for r in rows:
        ids = enc.encode(texts[r.doc_id], add_special_tokens=False).ids
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(enc.decode(ids, skip_special_tokens=False)))
