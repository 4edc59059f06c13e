"""Importance resampling against plain sums over all n-grams."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectio.llm import resample as R

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, ngrams):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return words, [" ".join(words[i:i + k]) for k in range(1, ngrams + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, ngrams=2, buckets=10_000, percent=25, min_words=20):
    def bag(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, ngrams)[1])
    s, t = bag(x for _, x in docs), bag(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        words, fs = features(text, ngrams)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= min_words))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = able[:percent * len(able) // 100]
    return sorted([(*r[:4], k + 1) for k, r in enumerate(drawn)] + [(*r[:4], None) for r in able[len(drawn):]] + [(*r[:4], None) for r in rows if not r[4]], key=str)


def frames(spark, docs, target):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("rank", F.lit(1))
    return d, spark.createDataFrame([(t,) for t in target], "text string")


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("ngrams,buckets", [(2, 10_000), (3, 100), (1, 64)])
def test_resample_equals_plain(spark, ngrams, buckets):
    rng = random.Random(3)
    words = ["Alpha", "béta", "x1", "İ", "naïve", "the", "of", "-", "数据", "\x00", "Zz_q"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 30, 80])))) for i in range(120)]
    docs += [(7, docs[7][1]), (500, None), (501, ""), (None, "the of " * 40), (502, "long word " * 50_000), (503, "ab" * 2_000_000), (-4, "the " * 25)]
    target = [" ".join(rng.choices(words[:5], k=40)) for _ in range(9)] + [None, ""]
    assert got(R.resample(*frames(spark, docs, target), ngrams=ngrams, buckets=buckets)) == plain(docs, target, ngrams, buckets)


def test_windows_do_not_change_counts(monkeypatch):
    text = "".join(random.Random(5).choices("ab é-\n", k=4000))
    whole = R.bucket_counts(text, 3, 997)
    monkeypatch.setattr(R, "WINDOW", 7)
    cut = R.bucket_counts(text, 3, 997)
    assert (whole[0] == cut[0]).all() and whole[1] == cut[1]


def test_bit_planes_give_exact_sums():
    rng = np.random.default_rng(1)
    gain = rng.integers(-90_000, 90_000, 1000)
    counts = [rng.integers(0, 2 ** k, 1000) for k in (1, 3, 40)] + [np.zeros(1000, np.int64)]
    own = [R.planes(c) for c in counts]
    owner = np.repeat(np.arange(4), [len(p) for p in own])
    power = np.concatenate([np.arange(len(p)) for p in own])
    sums = R.weight_sums(owner, power, np.concatenate(own), 4, (R.planes(np.maximum(gain, 0)), R.planes(np.maximum(-gain, 0))))
    assert sums == [sum(int(a) * int(b) for a, b in zip(c, gain)) for c in counts]


def test_empty_tables(spark):
    d, t = frames(spark, [], [])
    assert R.resample(d, t).count() == 0
    d, t = frames(spark, [(1, "a b")], [])
    assert got(R.resample(d, t)) == plain([(1, "a b")], [])
