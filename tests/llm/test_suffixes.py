"""Removal of repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectio.llm import suffixes

SF = "/root/testdata/sf0.001"


def plain_cut(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def against_plain(docs, **options):
    length = options.get("length", suffixes.LENGTH)
    rows = docs.collect()
    want = [(r["doc_id"], *x) for r, x in zip(rows, plain_cut([(r["text"] or "").encode() for r in rows], length))]
    got = suffixes.cut_repeats(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    return got


def made(seed, n=120, alphabet="abcdé "):
    """Texts with copies, shared passages, edits, overlaps and periods."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    passages = [word(rng.randint(20, 200)) for _ in range(8)]
    out = []
    for i in range(n):
        kind = rng.randrange(6)
        if kind == 0 and out:
            out.append(rng.choice(out))
        elif kind == 1 and out:
            t = list(rng.choice(out))
            for _ in range(rng.randint(1, 4)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(alphabet)
            out.append("".join(t))
        elif kind == 2:
            out.append(word(rng.randint(0, 5)) + "ab" * rng.randint(0, 120) + word(rng.randint(0, 60)))
        else:
            out.append(word(rng.randint(0, 90)) + "".join(rng.choice(passages)[rng.randint(0, 15):] + word(rng.randint(0, 30)) for _ in range(rng.randint(0, 4))))
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("path", ["sorted", "joined anchors", "heavy cores", "small buckets"])
def test_small_lengths(spark, seed, path, monkeypatch):
    monkeypatch.setattr(suffixes, "STEP", 7)
    monkeypatch.setattr(suffixes, "SHALLOW", 16)
    if path == "joined anchors":
        monkeypatch.setattr(suffixes, "ANCHOR_BROADCAST", 0)
    if path == "heavy cores":
        monkeypatch.setattr(suffixes, "HEAVY_CORE", 2)
    if path == "small buckets":
        monkeypatch.setattr(suffixes, "BUCKET_BYTES", 500)
    docs = spark.createDataFrame(made(seed), "doc_id long, text string")
    got = against_plain(docs, length=30 + seed, gram=9)
    assert sum(r["n_removed"] for r in got) > 1000


def test_documents(spark):
    got = against_plain(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    assert sum(r["n_removed"] for r in got) > 0


def test_odd_rows(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh \n") for _ in range(900))
    rows = [(1, None), (2, ""), (3, "x" * 399), (4, "x" * 400), (5, "y" * 401), (None, text), (6, text[200:700]), (6, text[200:700]), (7, "z" * 60_000),
            (8, text[:399]), (9, "prefix " + text[100:500]), (10, "é" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_bytes", F.lit(1)).withColumn("kept", F.lit(2))
    against_plain(docs)
    assert suffixes.cut_repeats(docs.limit(0)).count() == 0


def test_classes_against_plain():
    rng = random.Random(4)
    for length in (5, 16, 33, 40):
        buf = bytes(rng.choice(b"ab") for _ in range(300)) + b"abab" * 40 + bytes(rng.choice(b"abc") for _ in range(200))
        buf = buf + buf[50:200]
        pos = np.arange(len(buf) - length + 1)
        want = Counter(buf[i:i + length] for i in pos)
        want = {i for i in pos.tolist() if want[buf[i:i + length]] > 1}
        got = {}
        for part, (members, number) in enumerate(suffixes.deep_shallow_classes(np.frombuffer(buf, np.uint8), pos, length)):
            for m, k in zip(members.tolist(), number.tolist()):
                assert got.setdefault((part, k), buf[m:m + length]) == buf[m:m + length]
                want.discard(m)
        assert not want and len(set(got.values())) == len(got)
