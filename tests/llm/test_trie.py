import collections
import hashlib
import random
import zlib

from obsweave.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, CONV string, d int"


def brute(rows):
    """Every node with its members and subtree, by dictionaries."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    path = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        lead = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        path[c] = own.get(lead, [])[:h] + v[h:]
    members = collections.defaultdict(list)
    for c, p in path.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    out, below = [], collections.defaultdict(list)
    for n in members:
        for d in range(len(n) + 1):
            below[n[:d]].append(n)
    kids = collections.Counter(n[:-1] for n in members if n)
    for n, m in members.items():
        saved = sum((len(members[u]) - 1) * len(u[-1][1]) for u in below[n] if u)
        ends = ",".join(str(c) for c in sorted(m) if len(path[c]) == len(n))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], sum(not kids[u] for u in below[n]), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in trie.trie(df).collect()), key=repr)


def test_op11_equals_brute_force(spark):
    rng = random.Random(11)
    say = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "été", None, ""]))
    rows = []
    for c in [*rng.sample(range(450), 150), -3, -100, -250, 2**40, None]:
        if c is None or c % 100 or rng.random() < 0.7:
            rows += [(c, rng.choice([k, k, k // 2, None]), *say()) for k in range(rng.randrange(1, 9))]
    for c in (301, 302, 399):  # copies, and a conversation that ends inside another's head
        rows += [(c, k, "user", "same") for k in range(12)]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_op11_a_conversation_longer_than_a_task(spark):
    rows = [(7, k, "user", f"{k % 3}") for k in range(900)] + [(c, k, "user", f"{k % 3}") for c in (3, 8, 9) for k in range(40)] + [(9, None, None, "x" * 100_000)]
    assert run(spark, rows) == brute(rows)


def test_op11_many_ends_at_one_node(spark):
    rows = [(c, k, "user", "hello") for c in range(1, 3000) for k in range(7)]
    assert run(spark, rows) == brute(rows)


def test_op11_no_rows_and_no_turns(spark):
    assert run(spark, []) == [] and run(spark, [(None, 1, "user", "x")]) == []
    assert run(spark, [(5, None, None, None)]) == brute([(5, None, None, None)])
