"""Queries that SQL can't express, on the given tables of sf0.01, against brute force."""
import collections
import hashlib
import re

import pytest

from obsweave.llm import bpe, jaccard, suffix, trie
from obsweave.llm.tokens import WordEncoder, default_path

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_op4_query(spark, texts):
    first, want = {}, {}
    for i in sorted(texts):
        b = texts[i].encode()
        gone = bytearray(len(b))
        own = set()
        for k in range(len(b) - 49):
            h = hash(b[k : k + 50])
            if first.get(h, i) < i:
                gone[k : k + 50] = b"\1" * 50
            own.add(h)
        for h in own:
            first.setdefault(h, i)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[i] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.query(spark, SF).collect()}
    assert got == want


def test_op6_query(spark, texts):
    tok = WordEncoder.get(default_path()).tokenizer
    want = {}
    for i, t in texts.items():
        ids = tok.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.query(spark, SF).collect()} == want


def test_op9_query(spark, texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    by = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    shared = collections.Counter()
    for docs in by.values():
        shared.update((a, b) for n, a in enumerate(docs) for b in docs[n + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.query(spark, SF).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}


def test_op11_copies_of_one_conversation_do_not_own(spark):
    rows = [(c, k, "user", f"{k}") for c in (101, 103, 104) for k in range(8)]
    nodes = trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all(n.conv_id == 101 or n.n_convs < 3 for n in nodes) and min(n.conv_id for n in nodes) == 101
