"""Benchmark decontamination: rare word pairs as seeds, then Smith-Waterman alignment.

Words are runs without ASCII punctuation or space, A-Z lower-cased; of scripts written
without spaces (Chinese, Japanese, Thai, Lao, Khmer, Burmese, Tibetan) each character is a word, and
their punctuation separates words too.  The benchmark is taken in blocks of bounded size; for each block:

1. one pass over the corpus counts in how many documents each of the block's pairs of
   words at distance 1 or 2 occurs (map-side sums, then one grouped sum);
2. an item's seeds are the pairs that start at its rarest words' places.  A copy that reaches the
   score has, for an item of m words, at least ceil(min_score m) - 1 places where at most one
   edit separates two matching words (each other place costs two edits, and a match pays
   two), so all but that many of the frequent places can be left out: with ``SPARE`` more kept,
   every such copy has ``SPARE`` seeds or more, wherever and however it was edited;
3. a second pass finds seeds in the documents.  Seeds of one item whose diagonals differ by no more
   than the gaps that the score allows give a window of the document; windows whose words
   cannot reach the score are dropped by an exact bound, the others are aligned (Smith-Waterman on words:
   match 2, mismatch -1, gap -1).  A hit has at least ``min_score`` of an item's full score.

Work is done where the documents lie, so copies of one passage in many documents
cost each document its own alignment and no shuffle.

Items of fewer than ``min_words`` words are found where their whole word sequence stands
(score 1), since a part of so few words says nothing.

Rules for odd rows: null or empty text has no hit; items that are null or have no word are
not looked for; repeated items and documents are reported each.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, spans, written

MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES = 8 << 20       # benchmark text handled (and sent to tasks) at once
ALIGN_CELLS = 2_000_000     # matrix cells (one row of all pairs) aligned at once
SPARE = 3                   # seeds that a copy has at least (fewer if the score asks for fewer)
_PUNCTUATION = bytes(c for c in range(128) if not (chr(c).isalnum()))
_TO_SPACE = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))


#: UTF-8 of characters that stand for themselves, and of the punctuation between them.
_SPACELESS = re.compile(
    rb"((?:\xe0[\xb8-\xbf]|\xe1(?:[\x80-\x82]|[\x9e\x9f])|\xe3[\x81-\x83\x90-\xbf]|[\xe4-\xe9][\x80-\xbf]|\xef[\xa4-\xab])[\x80-\xbf]"
    rb"|\xe3\x80[\x85-\x87]|\xe3\x84[\x80-\xaf]|\xea(?:[\x80-\x92])[\x80-\xbf]|\xef\xbd[\xa6-\xbf]|\xef\xbe[\x80-\x9d]|\xf0[\xa0-\xbf][\x80-\xbf]{2})"
    rb"|\xe3\x80[\x80-\x84\x88-\xbf]|\xef\xbc[\x81-\x8f\x9a-\xa0]|\xef\xbd[\xa1-\xa5]")


def words(text: bytes | None) -> list[bytes]:
    if not text:
        return []
    if not text.isascii() and _SPACELESS.search(text):
        text = _SPACELESS.sub(rb" \1 ", text)
    return text.lower().translate(_TO_SPACE).split()


@dataclass
class Items:
    """A block of the benchmark: word numbers (0 is any other word) and its pairs of words."""
    ids: list
    vocabulary: dict[bytes, int]
    seqs: list[np.ndarray]
    grams: np.ndarray                   # sorted distinct pairs
    where: list[tuple]                  # per item, the places in it and in ``grams`` of its pairs
    short: dict[int, dict[bytes, list]]  # by length, the word numbers of items found whole, and their ids

    @classmethod
    def of(cls, rows: list[tuple[object, bytes]], min_words: int) -> "Items":
        vocabulary: dict[bytes, int] = {}
        ids, seqs, short = [], [], {}
        for key, text in rows:
            w = words(text)
            seq = np.array([vocabulary.setdefault(x, len(vocabulary) + 1) for x in w], np.int64)
            if len(w) >= max(min_words, 2):
                ids.append(key)
                seqs.append(seq)
            elif w:
                short.setdefault(len(w), {}).setdefault(seq.tobytes(), []).append(key)
        own = [pairs(s) for s in seqs]
        grams = np.unique(np.concatenate([h for _, h in own])) if own else np.zeros(0, np.uint64)
        return cls(ids, vocabulary, seqs, grams, [(at, np.searchsorted(grams, h)) for at, h in own], short)

    def numbers(self, ws: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in ws], np.int64)

    def find(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a document and the block's pairs that start there."""
        if not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, h = pairs(seq)
        g = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
        hit = self.grams[g] == h
        return at[hit], g[hit]


    def whole(self, seq: np.ndarray) -> list[tuple[object, int, int]]:
        """The short items that stand in a document as a whole, with the words of their first copy."""
        first: dict[bytes, tuple] = {}
        for n, known in self.short.items():
            if len(seq) >= n:
                heads = np.unique([np.frombuffer(x, np.int64)[0] for x in known])
                for p in np.flatnonzero(np.isin(seq[:len(seq) - n + 1], heads)).tolist():
                    x = seq[p:p + n].tobytes()
                    if x in known:
                        first.setdefault(x, (known[x], p, p + n))
        return [(key, p, e) for keys, p, e in first.values() for key in keys]


def pairs(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and numbers of the pairs of known words at distance 1 and 2."""
    at, h = [], []
    for d in (1, 2):
        p = np.flatnonzero((seq[:-d] != 0) & (seq[d:] != 0))
        at.append(p)
        h.append(seq[p].astype(np.uint64) << np.uint64(32) | seq[p + d].astype(np.uint64))
    return np.concatenate(at), np.concatenate(h)


def _least(m: int, min_score: float) -> int:
    """Seeds that a copy of an item of m words has at least."""
    return max(1, min(SPARE, math.ceil(min_score * m) - 1))


def _seeds(items: Items, df: np.ndarray, min_score: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seed table sorted by pair: pair, item, place in the item."""
    out = [np.zeros((0, 3), np.int64)]
    for i, (at, own) in enumerate(items.where):
        m = len(items.seqs[i])
        often = np.bincount(at, df[own], m - 1)
        take = min(m - 1, m - 1 - (math.ceil(min_score * m) - 1) + _least(m, min_score))
        pick = np.isin(at, np.argsort(often, kind="stable")[:take])
        out.append(np.column_stack((own[pick], np.full(pick.sum(), i), at[pick])))
    t = np.concatenate(out)
    t = t[np.lexsort((t[:, 2], t[:, 1], t[:, 0]))]
    return t[:, 0], t[:, 1], t[:, 2]


def smith_waterman(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each pair and the place in the window where it ends.  All pairs
    advance together; a row is one prefix maximum, which carries gaps along the window."""
    k, wide, tall = len(items), max(map(len, windows)), max(map(len, items))
    b = np.full((k, wide), -1, np.int64)
    a = np.full((k, tall), -2, np.int64)
    for i in range(k):
        b[i, :len(windows[i])] = np.where(windows[i] == 0, -1, windows[i])
        a[i, :len(items[i])] = items[i]
    row = np.zeros((k, wide + 1), np.int32)
    best, end = np.zeros(k, np.int32), np.zeros(k, np.int64)
    climb = (np.arange(wide + 1) * -GAP).astype(np.int32)
    for j in range(tall):
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(row[:, :-1] + np.where(b == a[:, j:j + 1], MATCH, MISMATCH), row[:, 1:] + GAP)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + climb, axis=1) - climb
        top = new.max(axis=1)
        better = top > best
        best[better], end[better] = top[better], new[better].argmax(axis=1)
        row = new
    return best, end


def _windows(items: Items, seeds, seq: np.ndarray, need: list[float], least: np.ndarray):
    """(item, window start, window end) that can still reach the score."""
    at, gram = items.find(seq)
    if not len(at):
        return []
    sg, si, sp = seeds
    lo, hi = np.searchsorted(sg, gram), np.searchsorted(sg, gram, side="right")
    n = hi - lo
    if not n.sum():
        return []
    which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place, item, offset = np.repeat(at, n), si[which], sp[which]
    order = np.lexsort((place - offset, item))
    item, diagonal = item[order], (place - offset)[order]
    reach = np.array([MATCH * len(x) - y for x, y in zip(items.seqs, need)])[item].astype(np.int64)      # gaps that the score allows
    # seeds that stand with enough others of their item
    k = least[item]
    last = np.arange(len(item)) + k - 1
    ends = np.minimum(last, len(item) - 1)
    group = (last < len(item)) & (item[ends] == item) & (diagonal[ends] - diagonal <= reach)
    cover = np.zeros(len(item) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(group), 1)
    np.add.at(cover, last[group] + 1, -1)
    keep = np.cumsum(cover[:-1]) > 0
    item, diagonal, reach = item[keep], diagonal[keep], reach[keep]
    if not len(item):
        return []
    apart = np.concatenate(([True], (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > reach[1:])))
    first = np.flatnonzero(apart)
    last = np.concatenate((first[1:], [len(item)])) - 1
    out = []
    for f, e in zip(first.tolist(), last.tolist()):
        i = int(item[f])
        m, r = len(items.seqs[i]), int(reach[f])
        s, t = max(0, int(diagonal[f]) - r), min(len(seq), int(diagonal[e]) + m + r)
        # the score is at most MATCH times the words that item and window share
        have = np.bincount(seq[s:t][np.isin(seq[s:t], items.seqs[i])], minlength=1)
        want = np.bincount(items.seqs[i], minlength=len(have))
        if MATCH * np.minimum(have, want[:len(have)]).sum() >= need[i]:
            out.append((i, s, t))
    return out


def _frequencies(docs: DataFrame, text_col: str, sent) -> DataFrame:
    def run(batches):
        items = sent.value
        total = np.zeros(len(items.grams), np.int64)
        for b in batches:
            for text in b.column("_text").to_pylist():
                g = items.find(items.numbers(words(text)))[1]
                if len(g):
                    total[np.unique(g)] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])
    return (docs.select(F.col(text_col).cast("binary").alias("_text")).mapInArrow(run, "gram long, n long")
            .groupBy("gram").agg(F.sum("n").alias("n")))


def _hits(docs: DataFrame, text_col: str, keep: tuple[str, ...], sent, seeds_sent, min_score: float) -> DataFrame:
    schema = docs.select(*keep).schema.add("item_id", sent.value_type).add("score", "double").add("word_from", "long").add("word_to", "long")

    def run(batches):
        items, seeds = sent.value, seeds_sent.value
        need = [min_score * MATCH * len(s) for s in items.seqs]
        least = np.array([_least(len(s), min_score) for s in items.seqs], np.int64)
        kind = pa.int64() if sent_long else pa.string()
        for b in batches:
            jobs, whole = [], []
            for row, text in enumerate(b.column("_text").to_pylist()):
                seq = items.numbers(words(text))
                if items.short:
                    whole += [(row, key, 1.0, f, t) for key, f, t in items.whole(seq)]
                jobs += [(row, i, s, t, seq[s:t]) for i, s, t in _windows(items, seeds, seq, need, least)]
            jobs.sort(key=lambda x: len(x[4]))
            found: dict[tuple[int, int], tuple] = {}
            for s, e in spans([len(x[4]) for x in jobs], ALIGN_CELLS // 16):
                part = jobs[s:e]
                score, end = smith_waterman([items.seqs[x[1]] for x in part], [x[4] for x in part])
                for x, v, z in zip(part, score.tolist(), end.tolist()):
                    if v >= need[x[1]]:
                        got = (v / (MATCH * len(items.seqs[x[1]])), x[2], x[2] + z)
                        found[x[0], x[1]] = max(found.get((x[0], x[1]), got), got)
            hits = [(r, items.ids[i], *found[r, i]) for r, i in sorted(found)] + whole
            rows = pa.array([x[0] for x in hits], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c).take(rows) for c in keep],
                 *[pa.array([x[j] for x in hits], t) for j, t in ((1, kind), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]],
                [*keep, "item_id", "score", "word_from", "word_to"])
    sent_long = sent.value_type == "long"
    return docs.select(*keep, F.col(text_col).cast("binary").alias("_text")).mapInArrow(run, schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
               item_col: str = "item_id", item_text_col: str = "text", min_score: float = 0.5, min_words: int = 8) -> DataFrame:
    """The columns ``keep`` of a document, ``item_id``, ``score`` (0 to 1, of the item's full
    score) and the words of the document it lies in: a row per document and item found."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = "long" if dict(benchmark.dtypes)[item_col] in ("bigint", "int", "smallint", "tinyint") else "string"
    items = benchmark.select(F.col(item_col).cast(kind).alias("id"), F.col(item_text_col).cast("binary").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(-(-size // BLOCK_BYTES)) or 1
    items = items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    out = None
    for block in range(blocks):
        rows = items.where(F.col("block") == block).collect()           # about BLOCK_BYTES
        rows.sort(key=lambda r: (r["id"] is None, r["id"] if r["id"] is not None else 0, bytes(r["text"])))
        made = Items.of([(r["id"], bytes(r["text"])) for r in rows], min_words)
        sent = spark.sparkContext.broadcast(made)
        sent.value_type = kind
        df = np.zeros(len(made.grams), np.int64)
        for r in _frequencies(docs, text_col, sent).collect():          # one row per pair of the block
            df[r["gram"]] = r["n"]
        seeds = spark.sparkContext.broadcast(_seeds(made, df, min_score))
        hits = _hits(docs, text_col, keep, sent, seeds, min_score)
        out = hits if out is None else out.unionByName(hits)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a copy of a benchmark item."""
    numbered = written(docs.withColumn("_row", F.monotonically_increasing_id()), "leak-docs")
    leaks = find_leaks(numbered, benchmark, text_col=text_col, keep=("_row",), **options).select("_row").distinct()
    return numbered.join(leaks, "_row", "left_anti").drop("_row")
