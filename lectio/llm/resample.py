"""Importance resampling towards a target distribution with bit-sliced weights.

Every text has a bag of word n-grams hashed into buckets.  A bucket's gain is the log of its
share in the target over its share in the corpus, both smoothed, as an integer.  A
document's weight is the mean gain of its n-grams, exact to the integer:

* the document's bucket counts become bit planes: plane j has bit b set when bit j of the
  count in bucket b is set (10,000 buckets make planes of 1,250 bytes);
* the gains become signed planes: those of the positive parts and those of the negative parts;
* weight sum = sum over count planes j and gain planes i of 2^(i+j) times
  popcount(count plane j AND gain plane i), with the sign of the gain plane.

Only bucket totals (one row a bucket, a parameter) reach the driver; everything else is per
document.  Documents then draw by their weight plus Gumbel noise from a hash of the id: the
highest scores among documents of ``min_words`` words or more, ranked by a range-sorted index.

Defined cases: a null or empty text has no n-grams, weight 0, and is never drawn; repeated rows
count as rows and share a score, so their ranks are adjacent; a null doc_id hashes as an
empty one and comes last among ties; an empty target or corpus has zero totals; other columns are
ignored.  Texts are read whole, in windows cut between words, so a long one needs no list of all its words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.indexing import with_row_index
from .common import small_batches, written

BUCKETS = 10_000
#: Bytes of a text whose words are listed at once.
WINDOW = 1 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")        # in UTF-8 after lower-casing: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def _windows(data: bytes) -> Iterator[bytes]:
    """``data`` in pieces of about WINDOW bytes that end between words."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + WINDOW)
        end = gap.end() if gap else len(data)
        yield data[at:end]
        at = end


def bucket_counts(text: str | None, ngrams: int, buckets: int) -> tuple[np.ndarray, int]:
    """Counts of a text's runs of 1 to ``ngrams`` words by CRC-32 bucket, and its number of words.
    A run's checksum continues the checksum of the run without its last word."""
    counts, n_words, tail = np.zeros(buckets, np.int64), 0, []
    for part in _windows((text or "").encode().lower()):
        fresh = _WORD.findall(part)
        n_words += len(fresh)
        words = tail + fresh
        runs = list(map(crc32, words))
        for k in range(1, ngrams + 1):
            if k > 1:
                runs = list(map(crc32, words[k - 1:], map(crc32, repeat(b" "), runs[:len(words) - k + 1])))
            new = runs[max(0, len(tail) - k + 1):]                   # the others ended in an earlier window
            if new:
                counts += np.bincount(np.array(new, np.int64) % buckets, minlength=buckets)
        tail = words[max(0, len(words) - ngrams + 1):] if ngrams > 1 else []
    return counts, n_words


def bucket_totals(docs: DataFrame, ngrams: int = 2, buckets: int = BUCKETS) -> np.ndarray:
    """All texts' n-grams by bucket: every task sends one row a bucket at most."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for text in b.column(0):
                total += bucket_counts(text.as_py(), ngrams, buckets)[0]
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], names=["bucket", "n"])

    small_batches(docs.sparkSession)
    rows = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln of the smoothed share in the target over that in the corpus), by bucket."""
    size = len(corpus)
    all_s, all_t = float(int(corpus.sum()) + size), float(int(target.sum()) + size)
    return np.array([math.floor(scale * math.log((t + 1) * all_s / ((s + 1) * all_t)))
                     for s, t in zip(corpus.astype(float), target.astype(float))], np.int64)


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of non-negative integers: row j holds bit j of every value, 64 values a word."""
    words = -(-len(values) // 64)
    top = int(values.max(initial=0)).bit_length()
    bits = np.zeros((top, words * 64), np.uint8)
    for j in range(top):
        bits[j, :len(values)] = (values >> j) & 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def weight_sums(owner: np.ndarray, power: np.ndarray, count_planes: np.ndarray, n_docs: int, gain_planes) -> list[int]:
    """Exact sums of count times gain.  Row r of ``count_planes`` is plane ``power[r]`` of document
    ``owner[r]``; ``gain_planes``: the planes of the positive and of the negative gains."""
    sums = [0] * n_docs
    for sign, side in zip((1, -1), gain_planes):
        for i, plane in enumerate(side):
            ones = np.bitwise_count(count_planes & plane).sum(axis=1, dtype=np.int64)
            for r in np.flatnonzero(ones):
                sums[owner[r]] += sign * (int(ones[r]) << (int(power[r]) + i))
    return sums


def weigh(docs: DataFrame, gain: np.ndarray, ngrams: int = 2) -> DataFrame:
    """doc_id, n_features, n_words and weight (floored mean gain of the n-grams) of every text."""
    spark = docs.sparkSession
    buckets = len(gain)
    sides = spark.sparkContext.broadcast((planes(np.maximum(gain, 0)), planes(np.maximum(-gain, 0))))

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            features, n_words, owner, power, rows = [], [], [], [], []
            for d, text in enumerate(texts):
                counts, n = bucket_counts(text.as_py(), ngrams, buckets)
                own = planes(counts)
                features.append(int(counts.sum()))
                n_words.append(n)
                owner += [d] * len(own)
                power += range(len(own))
                rows.append(own)
            stack = np.concatenate(rows) if rows else np.zeros((0, 1), np.uint64)
            sums = weight_sums(np.array(owner, np.int64), np.array(power, np.int64), stack, len(features), sides.value)
            weight = [s // n if n else 0 for s, n in zip(sums, features)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(features, pa.int64()), pa.array(n_words, pa.int64()), pa.array(weight, pa.int64())],
                                             names=["doc_id", "n_features", "n_words", "weight"])

    small_batches(spark)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_features long, n_words long, weight long")


def resample(docs: DataFrame, target: DataFrame, ngrams: int = 2, buckets: int = BUCKETS, percent: int = 25,
             min_words: int = 20, seed: int = 7, scale: int = 1000) -> DataFrame:
    """Every document's doc_id, n_features, n_words, weight, score and rank (null when not
    drawn): floor(percent * N / 100) of the N documents with ``min_words`` words, by
    score = weight + floor(-scale * ln(-ln(u))), u in (0, 1) from a hash of seed and id."""
    gain = gains(bucket_totals(docs, ngrams, buckets), bucket_totals(target, ngrams, buckets), scale)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10)
    u = (h.cast("double") + 0.5) / 4294967296.0
    noise = F.floor(F.lit(-float(scale)) * F.log(-F.log(u)))
    scored = written(weigh(docs, gain, ngrams).withColumn("score", (F.col("weight") + noise).cast("long")), "resample-scored")
    able = F.col("n_words") >= min_words
    n = scored.where(able).count()
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    ranked = with_row_index(scored.where(able), order, "at")
    rank = F.when(F.col("at") < percent * n // 100, F.col("at") + 1).cast("long")
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", rank).drop("at").select(*rest.columns).unionByName(rest)
