"""Conversation prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lectio.llm.prefix_trie import conversation_trie, node_turns, ordered_turns, share_heads, trie
from lectio.operators.prep import join_by_key

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows, every=5, heads=9):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            convs[c].append(((turn is not None, turn or 0), role, tie, text))
    seqs = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in convs.items()}
    if not every:
        return seqs
    out = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - int(c - every * int(c / every))
        out[c] = seqs.get(base, [])[:h] + own[h:]
    return out


def plain_trie(seqs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def under(p):
        todo, got = [p], []
        while todo:
            q = todo.pop()
            got.append(q)
            todo += kids[q]
        return got
    out = set()
    for p, m in members.items():
        sub = under(p)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in sub if q)
        ids = ",".join(map(str, sorted(ends[p])))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[q] for q in sub), saved,
                 hashlib.sha256(ids.encode()).hexdigest()))
    return out


def got(df):
    rows = [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made(seed, n, longest, hot=0):
    rng = random.Random(seed)
    words = ["a", "b", "é", "", None, "long text"]
    rows = []
    for c in rng.sample(range(-20, 200), n):
        for t in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(words)))
    for c in range(1000, 1000 + hot):
        rows += [(c, 0, "user", "same"), (c, 1, "assistant", "too")]
    return rows


@pytest.mark.parametrize("block", [2, 1024])
def test_trie_equals_plain(spark, block):
    rows = made(1, 40, 11)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(conversation_trie(df, block)) == plain_trie(rebuilt(rows, every=0))
    assert got(trie(*share_heads(*ordered_turns(df)), block)) == plain_trie(rebuilt(rows))


def test_odd_rows_and_copies(spark):
    rows = made(2, 25, 4, hot=60) + [(None, 1, "user", "nobody"), (7777, None, None, None), (7777, None, None, None), (10**12 + 3, 5, "", "x")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("name", F.lit(1)).withColumn("rep", F.lit("x")).withColumn("pos", F.lit(0))
    want = plain_trie(rebuilt(rows))
    assert got(trie(*share_heads(*ordered_turns(df)))) == want
    assert any(r[1] == 0 for r in want)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert conversation_trie(df).count() == 0
    assert trie(*share_heads(*ordered_turns(df))).count() == 0


def test_one_deep_conversation(spark):
    rows = [(c, t, "user", f"t{t}" if t < cut else f"c{c}t{t}") for c, n, cut in ((1, 700, 700), (2, 650, 333), (3, 40, 40), (4, 1, 1)) for t in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(conversation_trie(df, 16)) == plain_trie(rebuilt(rows, every=0))


def test_turnless_conversation_ends_at_the_root(spark):
    c = next(i for i in range(1, 200) if i % 5 and zlib.crc32(str(i).encode()) % 9 >= 2)
    rows = [(c, 0, "user", "gone")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = got(trie(*share_heads(*ordered_turns(df))))
    assert out == {(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())}


def test_node_turns(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    turns, convs = ordered_turns(df)
    out = {(r.conv_id, r.depth): (r.role, r.text) for r in node_turns(trie(turns, convs), turns, df).collect()}
    assert out == {(1, 0): (None, None), (1, 1): ("user", "hi"), (1, 2): ("assistant", "yo"), (2, 2): ("assistant", "")}


def test_join_by_key_takes_hot_keys_apart(spark):
    rows = spark.range(300).select((F.when(F.col("id") < 200, 0).when(F.col("id") < 205, None).otherwise(F.col("id"))).alias("k"), "id")
    lookup = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).where("k is not null and k < 290")
    for total in (300, 50_000 * 100):
        out = {r.id: r.least for r in join_by_key(rows, lookup, ["k"], "n", total).collect()}
        assert out == {i: (0 if i < 200 else i if 205 <= i < 290 else None) for i in range(300)}
