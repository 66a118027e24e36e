import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn int, role string, text string, k string, depth int"


def plain(rows, rebuild=True, every=20):
    """All nodes by whole tuples of turns."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    convs = own
    if rebuild:
        convs = {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 4
            convs[c] = own.get(c - c % every, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in children[node])
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(m), len(node), parent, len(m), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def told(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = ["hello there", "how are you", "", None, "what is\tthe\nmatter", "fine", "x " * 3000]
    out = []
    for c in list(range(0, 70)) + [140, 141, 160, 205, 5_000_000_000, 5_000_000_001]:
        if c % 20 == 0 and c in (40, 160):
            continue
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            out.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(texts), "x", 7))
    out += [(61, None, "user", "a null turn", "x", 7), (None, 0, "user", "no conversation", "x", 7)]
    out += [out[3], out[3]]  # repeated rows are turns of their own
    long = [(300 + i, t, "user", f"turn {t % 5}", "x", 7) for i in (0, 1) for t in range(400)]
    copies = [(1000 + i, t, "user", "the same", "x", 7) for i in range(120) for t in range(4)]
    return out + long + copies


def test_rebuilt_trie_equals_plain(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert told(ct.rebuilt_nodes(docs)) == plain(rows)


def test_own_trie_with_a_sketch_that_is_full(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain(rows, rebuild=False)
    assert told(ct.conversation_nodes(docs, rows=1, most_bits=16)) == want


def test_ties_have_one_order(spark):
    rows = [(1, 0, "user", "a", "x", 1), (1, 0, "user", "b", "x", 1), (2, 0, "user", "b", "x", 1), (2, 0, "user", "a", "x", 1)]
    got = told(ct.conversation_nodes(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain(rows, rebuild=False)  # whichever comes first, it does in both
    assert got == told(ct.conversation_nodes(spark.createDataFrame(rows[::-1], SCHEMA).repartition(4)))


def test_singletons_never_shuffle_and_estimates_are_never_low(spark, rows):
    convs = spark.createDataFrame(rows, SCHEMA)
    turns, _ = ct.rebuilt(ct.turns_of(convs))
    marked = ct._marked(turns)
    counts = marked.groupBy("k").agg(F.count("*").alias("n"), F.max("shared").alias("shared"), F.min("shared").alias("least"))
    assert counts.where("n > 1 and not least").count() == 0
    single, wrong = counts.where("n = 1").agg(F.count("*"), F.sum(F.col("shared").cast("int"))).first()
    assert single > 150 and wrong <= 0.02 * single


def test_ends_in_many_stretches(spark):
    ids = [*range(-20, 300), 10**12, 10**12 + 5]
    ends = spark.createDataFrame([(1, 2, c) for c in ids] + [(1, 3, 9)], "k1 long, k2 long, conv long").select(F.struct("k1", "k2").alias("k"), "conv")
    out = {(r.k.k1, r.k.k2): r.ends_sha256 for r in ct.digests_of_ends(ends, room=4).collect()}
    assert out == {(1, 2): hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), (1, 3): hashlib.sha256(b"9").hexdigest()}


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ct.rebuilt_nodes(none).count() == 0
    assert ct.conversation_nodes(none).count() == 0
