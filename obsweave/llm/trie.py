"""Prefix trie of conversations by smallest-member ownership.

A node of the trie belongs to its smallest member. Who owns a node owns all deeper nodes on its own path, so each conversation owns a suffix of its path, and sums over a
subtree become sums over members: a member adds, from the node down, the tokens of its turns that it does not own, and a leaf if it owns the last node of its path and nobody goes
on from there. One group-by of prefixes thus gives every sum at once, without a visit to the tree.

Places and prefixes come from one sort by (conversation, turn): each task adds up its stretch, and what a conversation has before a stretch is added where it goes on in the
next one, so that a conversation may be longer than a task. Prefixes are told apart by 128 bits (two polynomials over digests of turns). A node's smallest member is found by
windows over (node, salt), then by windows over the salts' smallest, so that no task holds all members of a node that many share."""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BASE, Stage, input_bytes, tune

HEAD = 5  # turns of another conversation at most
SHARE = 100  # conversations c - c % SHARE .. share their heads
SALTS = 64
CHUNK = 1 << 16  # bytes of ids that travel together
B = [BASE, BASE ^ 0x5DEECE66C]  # odd


def wraps(x: np.ndarray, y) -> np.ndarray:
    with np.errstate(over="ignore"):
        return x * y


def power(base: int, n: np.ndarray) -> np.ndarray:
    """base**n modulo 2**64."""
    out, p, n = np.ones(len(n), np.uint64), base, n.copy()
    while n.any():
        out = np.where(n & 1, wraps(out, np.uint64(p)), out)
        n >>= 1
        p = p * p % 2**64
    return out


def unsigned(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(batch.column(name)).astype(np.int64).view(np.uint64)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def turns(convs: DataFrame) -> DataFrame:
    """conv, turn, t1, t2 (128 bits of role and text), n (code points of the text); without rows that have no conv_id."""
    role, text = (F.coalesce(convs[c].cast("string"), F.lit("")) for c in ("role", "text"))
    md5 = F.md5(F.concat_ws(":", F.octet_length(role).cast("string"), F.concat(role, text)).cast("binary"))
    half = lambda k: F.conv(F.substring(md5, k, 16), 16, -10).cast("long")
    return convs.select(convs["conv_id"].cast("long").alias("conv"), convs["turn"].cast("long").alias("turn"), half(1).alias("t1"), half(17).alias("t2"), F.char_length(text).cast("long").alias("n")).where("conv IS NOT NULL")


SCAN = "conv long, pos long, h1 long, h2 long, e1 long, e2 long, tok long, n long, part int"


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's stretch in order: each turn's place in its conversation, prefixes with (h) and without it (e), tokens up to it; all counted from the stretch's begin."""
    last, pos, h, tok = None, 0, [0, 0], 0
    for b in batches:
        if not b.num_rows:
            continue
        conv, n = np.asarray(b.column("conv")), np.asarray(b.column("n"))
        t = [unsigned(b, c).tolist() for c in ("t1", "t2")]
        out = [np.zeros(len(conv), np.int64), *(np.zeros(len(conv), np.uint64) for _ in range(4)), np.zeros(len(conv), np.int64)]
        p, h1, h2, e1, e2, toks = out
        for i, (c, k, a, d) in enumerate(zip(conv.tolist(), n.tolist(), *t)):
            if c != last:
                last, pos, h, tok = c, 0, [0, 0], 0
            e1[i], e2[i] = h
            h = [(h[0] * B[0] + a) % 2**64, (h[1] * B[1] + d) % 2**64]
            pos, tok = pos + 1, tok + k
            p[i], h1[i], h2[i], toks[i] = pos, *h, tok
        yield pa.RecordBatch.from_arrays([b.column("conv"), pa.array(p), *map(signed, out[1:5]), pa.array(toks), pa.array(n), b.column("part")], [x.split()[0] for x in SCAN.split(", ")])


def scanned(slim: DataFrame, stage: Stage, parts: int) -> DataFrame:
    """conv, pos, h1, h2, e1, e2, tok, n of every turn, over whole conversations."""
    order = ["conv", F.col("turn").asc_nulls_first(), *(F.col(t).bitwiseXOR(F.lit(-(2**63)).cast("long")) for t in ("t1", "t2"))]  # as unsigned numbers
    dealt = slim.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    local = stage.write(dealt.mapInArrow(scan, SCAN), "local")
    ends = sorted(tuple(r) for r in local.groupBy("part").agg(F.min("conv"), F.max("conv")).collect())  # a row a task
    cut = {a[2] for a, b in zip(ends, ends[1:]) if a[2] == b[1]}  # conversations that go on in the next task
    if not cut:
        return local.drop("part")
    spark = slim.sparkSession
    marked = local.join(F.broadcast(spark.createDataFrame([(c,) for c in cut], "conv long")), "conv")  # at most one a task
    last = F.max_by(F.struct("h1", "h2", "tok"), "pos")
    carry, before = [], {}
    for part, conv, pos, end in sorted((r.part, r.conv, r.pos, r.end) for r in marked.groupBy("part", "conv").agg(F.max("pos").alias("pos"), last.alias("end")).collect()):
        had = before.get(conv, (0, 0, 0, 0))
        if had[0]:
            carry.append((part, conv, *(x - 2**64 if x >= 2**63 else x for x in had)))
        h = [(had[1 + k] * pow(B[k], pos, 2**64) + end[k]) % 2**64 for k in range(2)]
        before[conv] = (had[0] + pos, *h, had[3] + end.tok)
    held = spark.createDataFrame(carry, "part int, conv long, c_pos long, c1 long, c2 long, c_tok long")

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What went before, in front of a stretch: h(before + stretch) = h(before) * base**len(stretch) + h(stretch)."""
        for b in batches:
            has = np.asarray(b.column("c_pos").fill_null(0))
            pos = np.asarray(b.column("pos"))
            c = [np.asarray(b.column(x).fill_null(0)).astype(np.int64).view(np.uint64) for x in ("c1", "c2")]
            with np.errstate(over="ignore"):
                h = [unsigned(b, f"h{k + 1}") + wraps(c[k], power(B[k], pos)) for k in range(2)]
                e = [unsigned(b, f"e{k + 1}") + wraps(c[k], power(B[k], pos - 1)) for k in range(2)]
            tok = np.asarray(b.column("tok")) + np.asarray(b.column("c_tok").fill_null(0))
            yield pa.RecordBatch.from_arrays([b.column("conv"), pa.array(pos + has), *map(signed, [*h, *e]), pa.array(tok), b.column("n")], ["conv", "pos", "h1", "h2", "e1", "e2", "tok", "n"])

    return stage.write(local.join(F.broadcast(held), ["part", "conv"], "left").mapInArrow(moved, SCAN.removesuffix(", part int")), "whole")


def at(k: Column, name: str, n: int = HEAD) -> Column:
    """Column name_k of a row, 0 for k = 0."""
    return F.coalesce(*(F.when(k == i, F.col(f"{name}_{i}")) for i in range(1, n + 1)), F.lit(0).cast("long"))


PATH = "conv long, len long, total long, d long, k1 long, k2 long, p1 long, p2 long, before long"


def paths(places: DataFrame, stage: Stage) -> DataFrame:
    """Rows (conv, len, total, d, k1, k2, p1, p2, before): the nodes of each rebuilt conversation's path, the root at depth 0; k and p are prefixes of node and parent, `before` the tokens above
    the node, total those of the whole path, len its length."""
    first = [F.max(F.when(F.col("pos") == i, F.col(c))).alias(f"{c}_{i}") for c in ("h1", "h2", "tok") for i in range(1, HEAD + 1)]
    convs = places.groupBy("conv").agg(F.max("pos").alias("own"), F.max("tok").alias("own_tok"), *first)
    convs = stage.write(convs.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % (HEAD + 1)).withColumn("lead", F.col("conv") - F.col("conv") % SHARE), "own")
    heads = convs.where(F.col("conv") % SHARE == 0).select(F.col("conv").alias("lead"), F.least("own", F.lit(HEAD).cast("long")).alias("there"), *(F.col(f"{c}_{i}").alias(f"b_{c}_{i}") for c in ("h1", "h2", "tok") for i in range(1, HEAD + 1)))
    met = convs.join(heads, "lead", "left").withColumn("hb", F.least("h", F.coalesce("there", F.lit(0))).cast("long")).withColumn("cut", F.least("h", "own"))
    met = met.withColumn("len", F.col("hb") + F.col("own") - F.col("cut"))
    for c in ("h1", "h2", "tok"):
        met = met.withColumn(f"head_{c}", at(F.col("hb"), f"b_{c}")).withColumn(f"cut_{c}", at(F.col("cut"), c))
    met = met.withColumn("total", F.col("head_tok") + F.col("own_tok") - F.col("cut_tok"))
    met = stage.write(met.select("conv", "len", "total", "hb", "h", "cut", *(f"{x}_{c}" for x in ("head", "cut") for c in ("h1", "h2", "tok")), *(f"b_{c}_{i}" for c in ("h1", "h2", "tok") for i in range(1, HEAD + 1))), "convs")
    zero = F.lit(0).cast("long")
    steps = [F.struct(F.lit(0).cast("long").alias("d"), zero.alias("k1"), zero.alias("k2"), zero.alias("p1"), zero.alias("p2"), zero.alias("before"))]
    for i in range(1, HEAD + 1):
        prior = [F.col(f"b_{c}_{i - 1}") if i > 1 else zero for c in ("h1", "h2", "tok")]
        steps.append(F.struct(F.lit(i).cast("long").alias("d"), F.col(f"b_h1_{i}").alias("k1"), F.col(f"b_h2_{i}").alias("k2"), prior[0].alias("p1"), prior[1].alias("p2"), prior[2].alias("before")))
    tops = met.select("conv", "len", "total", F.explode(F.slice(F.array(*steps), 1, (F.col("hb") + 1).cast("int"))).alias("s")).select("conv", "len", "total", "s.*")
    rest = places.join(met.select("conv", "len", "total", "hb", "h", "cut", *(f"{x}_{c}" for x in ("head", "cut") for c in ("h1", "h2", "tok"))), "conv").where("pos > h")

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Own prefixes with the head of another conversation in place of the own one: h(i) + (h(head) - h(own head)) * base**(turns since)."""
        for b in batches:
            col = lambda x: np.asarray(b.column(x)).astype(np.int64)
            since = col("pos") - col("cut")
            with np.errstate(over="ignore"):
                gap = [unsigned(b, f"head_h{k}") - unsigned(b, f"cut_h{k}") for k in (1, 2)]
                k = [unsigned(b, f"h{i + 1}") + wraps(gap[i], power(B[i], since)) for i in range(2)]
                p = [unsigned(b, f"e{i + 1}") + wraps(gap[i], power(B[i], since - 1)) for i in range(2)]
            before = col("tok") - col("n") + col("head_tok") - col("cut_tok")
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("len"), b.column("total"), pa.array(col("hb") + since), *map(signed, [*k, *p]), pa.array(before)], [x.split()[0] for x in PATH.split(", ")])

    return stage.write(tops.unionByName(rest.mapInArrow(rebuilt, PATH)), "paths")


KEY = ["d", "k1", "k2"]


def owned(path: DataFrame, salts: int) -> DataFrame:
    """The path rows of smallest members, one a node, with `far`: the longest path of the node's members."""
    some = Window.partitionBy(*KEY, "salt")
    per = path.withColumn("salt", F.pmod(F.xxhash64("conv"), F.lit(salts))).withColumn("least", F.min("conv").over(some)).withColumn("far", F.max("len").over(some)).where("conv = least")
    every = Window.partitionBy(*KEY)
    return per.withColumn("least", F.min("conv").over(every)).withColumn("far", F.max("far").over(every)).where("conv = least").drop("salt", "least")


def packed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of node and id: runs of ids of one node as text, squeezed."""

    def row(key, ids):
        return (*key, ids[0], zlib.compress(",".join(map(str, ids)).encode(), 1))

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], ty) for k, ty in enumerate([pa.int64()] * 4 + [pa.binary()])], [*KEY, "first", "run"])

    key, ids, size, rows = None, [], 0, []
    for b in batches:
        for *k, c in zip(*(b.column(x).to_pylist() for x in (*KEY, "conv"))):
            if k != key or size > CHUNK:
                if ids:
                    rows.append(row(key, ids))
                key, ids, size = k, [], 0
            ids.append(c)
            size += 8
        if rows:
            yield batch(rows)
            rows = []
    if ids:
        yield batch([row(key, ids)])


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest for each node from its runs in order; holds one run at a time."""
    key, sha, rows = None, None, []
    for b in batches:
        for *k, run in zip(*(b.column(x) for x in (*KEY, "run"))):
            k, ids = [x.as_py() for x in k], zlib.decompress(run.as_buffer())
            if k == key:
                sha.update(b"," + ids)
                continue
            if sha is not None:
                rows.append((*key, sha.hexdigest()))
            key, sha = k, hashlib.sha256(ids)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows]) for k in range(4)], [*KEY, "ends_sha256"])
            rows = []
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, sha.hexdigest())], [*KEY, "ends_sha256"])


def trie(convs: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    Rows without conv_id belong to no conversation and are left out. Turns of one conversation with equal turn numbers come in order of an MD5 of role and text; rows that repeat are
    turns of their own. Null roles and texts are empty; texts may have any length. No rows give no nodes. Further columns are not read."""
    spark = convs.sparkSession
    tune(spark)
    stage = Stage(spark, "trie")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(input_bytes(convs) // (64 << 20)))
    slim = stage.write(turns(convs), "turns")
    path = paths(scanned(slim, stage, parts), stage)
    own = stage.write(owned(path, max(SALTS, parts // 4)), "owned")
    starts = own.groupBy("conv").agg(F.min(F.struct("d", "before")).alias("s"), F.max((F.col("d") == F.col("len")) & (F.col("far") == F.col("d"))).cast("long").alias("leaf")).select("conv", F.col("s.d").alias("s_d"), F.col("s.before").alias("s_before"), "leaf")
    met = path.join(starts, "conv", "left").withColumn("start", F.coalesce("s_d", F.col("len") + 1)).withColumn("upto", F.coalesce("s_before", "total"))  # a copy of earlier ones owns nothing
    saved = F.when(F.col("d") < F.col("start"), F.col("upto") - F.col("before")).otherwise(0)
    goes_on = (F.col("d") < F.col("len")) & (F.col("d") + 1 >= F.col("start"))
    owner = F.min(F.struct("conv", "start", "p1", "p2")).alias("o")
    nodes = met.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.sum(goes_on.cast("long")).alias("n_children"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum(saved).alias("saved_tokens"), owner)
    nodes = stage.write(nodes.select(*KEY, "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("o.conv").alias("conv_id"), F.col("o.start").alias("start"), F.col("o.p1").alias("p1"), F.col("o.p2").alias("p2")), "nodes")
    stage.drop("owned")
    last = path.where("d = len").select(*KEY, "conv")
    runs = last.repartitionByRange(parts, *KEY, "conv").sortWithinPartitions(*KEY, "conv").mapInArrow(packed_ids, "d long, k1 long, k2 long, first long, run binary")
    ended = stage.write(runs.repartition(parts, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digests, "d long, k1 long, k2 long, ends_sha256 string"), "ends")
    stage.drop("paths")
    # a parent's owner is the node's own, unless the owner's suffix begins at the node
    inner = nodes.where("d > 0 AND start = d").alias("n").join(nodes.select(F.col("d").alias("up"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id")).alias("p"), (F.col("n.d") - 1 == F.col("up")) & (F.col("n.p1") == F.col("p.p1")) & (F.col("n.p2") == F.col("p.p2"))).select("n.*", "parent_conv_id")
    whole = inner.unionByName(nodes.where("d = 0 OR start < d").withColumn("parent_conv_id", F.when(F.col("d") > 0, F.col("conv_id"))))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return whole.join(ended, KEY, "left").select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: DuckDB SQL for the query's rows.
ORACLE = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, b)) AS tab
), t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(octet_length(encode(coalesce(role, ''))), ':', coalesce(role, ''), coalesce(text, '')))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, x: xor(a >> 8, tab[CAST((xor(a, x) & 255) + 1 AS INTEGER)]), 4294967295), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t), crc
), r AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY late, pos) AS d, role, text
  FROM (SELECT c.conv_id, false AS late, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND pos <= h
        UNION ALL SELECT conv_id, true, pos, role, text FROM t JOIN c USING (conv_id) WHERE pos > h)
), p AS (
  SELECT conv_id, d, md5(string_agg(md5(concat(length(role), ':', role, text)), '') OVER (PARTITION BY conv_id ORDER BY d)) AS k, length(text) AS tok FROM r
  UNION ALL SELECT conv_id, 0, '', 0 FROM c
), n AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(tok) AS tok FROM p GROUP BY k, d
), up AS (
  SELECT DISTINCT x.k, y.k AS above FROM p x JOIN p y ON x.conv_id = y.conv_id AND y.d = x.d - 1
), kids AS (
  SELECT above AS k, count(*) AS n_children FROM up GROUP BY above
), sub AS (
  SELECT DISTINCT x.k AS top, y.k FROM p x JOIN p y ON x.conv_id = y.conv_id AND y.d >= x.d
), sums AS (
  SELECT top AS k, sum((n.n_convs - 1) * tok) AS saved_tokens, count(*) FILTER (WHERE kids.k IS NULL) AS n_leaves FROM sub JOIN n USING (k) LEFT JOIN kids USING (k) GROUP BY top
), ends AS (
  SELECT k, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM p JOIN (SELECT conv_id, max(d) AS len FROM p GROUP BY conv_id) USING (conv_id) WHERE d = len GROUP BY k
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM n JOIN sums USING (k) LEFT JOIN kids USING (k) LEFT JOIN ends USING (k) LEFT JOIN up USING (k) LEFT JOIN n q ON q.k = above
"""
