"""Language identification with interpolated Kneser-Ney character models.

Text is lower-cased, every run of non-letters becomes one space, and each document is
padded with one space at both ends.  A gram of ``ORDER`` characters is packed into one
64-bit number (16 bits a character; characters beyond the basic plane are folded into
it), so the "hash" of a gram is exact for the basic plane.  Spark counts the grams of all
training documents by language; from these counts come, per language, the absolute
discounts, the continuation counts of the lower orders and the back-off masses.  Each
order is a sorted array of hashes with one column of log probabilities and one of back-off
weights a language, looked up by binary search.  Every gram seen is kept.  A model too large
to send whole is cut into shards by the two middle characters of a gram, which its
continuation counts, contexts and lower orders share; each shard is exact for its
grams, and tasks hold one shard at a time and add up what the shards give a text.

A document goes to the language with the lowest cross-entropy per character.  Rejection
is calibrated: the documents of the calibration fold give, per language, the median of
that cross-entropy and the ``keep`` quantile of the excess over it, both on the scale of
``STEADY`` characters, since the excess of short texts varies as one over the root of
their length.  A document is rejected if its excess lies above that quantile by more than
``slack`` bits, or if it has no letter.

Rules for odd rows: null text or text without a letter is ``und`` with score 0 and is
rejected; a null lang is never learned; a null doc_id counts as held out; ties between
languages go to the first in code-point order; with no training rows every document is
``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, small_batches, spans, written

ORDER = 4
MAX_GRAMS = 1_000_000       # grams of four languages in one shard of a model; more languages, fewer grams
HELD_BYTES = 4_000_000      # text that a task scores by one shard after the other
FLUSH_GRAMS = 1_000_000     # distinct grams a task holds before it emits its counts
SPACE = 32
STEADY = 100                # characters from which on cross-entropy is taken to vary no less


def fold_of(id_col: str) -> Column:
    """crc32 of the id as text, mod 5 (null: 0)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5, F.lit(0).cast("long"))


def _letter_table() -> np.ndarray:
    """For each 16-bit character: its lower-case letter, or a space."""
    out = np.full(1 << 16, SPACE, np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else i
    return out


_LETTERS: list[np.ndarray] = []


def letters(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of letters and single spaces, each text padded by a space at
    both ends, and the length of each (2 or less: no letter)."""
    if not _LETTERS:
        _LETTERS.append(_letter_table())
    parts = [(t or b"").decode("utf-8", "replace") for t in texts]
    codes = np.frombuffer(("\n" + "\n\n".join(parts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    n = np.array([len(p) for p in parts], np.int64)
    wide = codes >= 1 << 16
    if wide.any():
        low = _LETTERS[0][np.where(wide, 0, codes)]
        big = np.flatnonzero(wide)
        low[big] = [(ord(chr(c).lower()[0]) & 0x7FFF | 0x8000) if chr(c).isalpha() else SPACE for c in codes[big].tolist()]
    else:
        low = _LETTERS[0][codes]
    owner = np.repeat(np.arange(len(parts)), n + 2)
    start = np.zeros(len(low), bool)
    start[np.cumsum(np.concatenate(([0], n[:-1] + 2)))] = True
    keep = (low != SPACE) | start
    keep[1:] |= low[:-1] != SPACE
    return low[keep], np.bincount(owner[keep], minlength=len(parts))


def packed(chars: np.ndarray, order: int) -> np.ndarray:
    """The grams ending at each position from ``order - 1`` on."""
    out = np.zeros(max(0, len(chars) - order + 1), np.uint64)
    for i in range(order):
        out = out << np.uint64(16) | chars[i:len(out) + i].astype(np.uint64)
    return out


def _inside(lengths: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Which grams of the joined array lie in one text, and the text of each gram."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    k = max(0, len(owner) - order + 1)
    return owner[:k] == owner[order - 1:] if k else np.zeros(0, bool), owner[:k]


def gram_counts(docs: DataFrame, lang_col: str, text_col: str, order: int = ORDER) -> DataFrame:
    """``lang, gram, n`` over the whole texts of all rows; counts are summed in each task first."""
    small_batches(docs.sparkSession)

    def run(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out():
            rows = [(np.full(len(g), i), g, c) for i, (g, c) in enumerate(held.values())]
            names = list(held)
            held.clear()
            if not rows:
                return
            lang, gram, n = (np.concatenate(x) for x in zip(*rows))
            for s in range(0, len(gram), 200_000):
                e = s + 200_000
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()).take(pa.array(lang[s:e])), pa.array(gram[s:e].view(np.int64)), pa.array(n[s:e])],
                    ["lang", "gram", "n"])
        for b in batches:
            texts, langs = b.column("_text").to_pylist(), b.column("_lang").to_pylist()
            at: dict[str, list[int]] = {}
            for i, x in enumerate(langs):
                at.setdefault(x, []).append(i)
            for lang, rows in at.items():
                own = [texts[i] for i in rows]
                for s, e in spans([len(t or b"") for t in own]):
                    chars, n = letters(own[s:e])
                    grams = packed(chars, order)[_inside(n, order)[0]]
                    gram, count = np.unique(grams, return_counts=True)
                    if lang in held:
                        gram = np.concatenate((held[lang][0], gram))
                        gram, back = np.unique(gram, return_inverse=True)
                        count = np.bincount(back, np.concatenate((held[lang][1], count)), len(gram)).astype(np.int64)
                    held[lang] = gram, count
            if sum(len(g) for g, _ in held.values()) > FLUSH_GRAMS:
                yield from out()
        yield from out()
    src = docs.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("binary").alias("_text"))
    return src.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class KneserNey:
    """Per order a sorted hash array; for each entry and language the log2 probability of
    its last character and the log2 weight with which its continuations back off."""

    def __init__(self, langs: list[str], hashes: list[np.ndarray], logp: list[np.ndarray], back: list[np.ndarray]):
        self.langs, self.hashes, self.logp, self.back = langs, hashes, logp, back

    @classmethod
    def fit(cls, langs: list[str], grams: list[np.ndarray], counts: list[np.ndarray], order: int = ORDER,
            lower: list | None = None, seen: list | None = None) -> "KneserNey":
        """grams, counts: by language, the distinct top-order grams and their counts.  For a
        shard, ``lower`` has by language the grams and continuation counts of the orders 1
        and 2, and ``seen`` how many grams of each order the whole model has once and twice."""
        size = len(langs)
        every = []
        for col in range(size):
            levels = [(grams[col], counts[col].astype(float))]   # the top order has counts, the lower ones continuation counts
            for k in range(order - 1, 0, -1):
                low, n = lower[col][k - 1] if lower and k <= 2 else np.unique(_last(levels[0][0], k), return_counts=True)
                levels.insert(0, (low, n.astype(float)))
            every.append(levels)
        # the grams of each order, and the contexts of the next one
        hashes = [np.unique(np.concatenate([x[k - 1][0] for x in every] + [x[k][0] >> np.uint64(16) for x in every if k < order])) if size else
                  np.zeros(0, np.uint64) for k in range(1, order + 1)]
        letters_seen = len(np.unique(np.concatenate([x[0][0] for x in every]))) if size else 0
        prob = [np.zeros((len(h), size)) for h in hashes]
        back = [np.ones((len(h), size)) for h in hashes]
        for col, levels in enumerate(every):
            for k in range(1, order + 1):
                gram, c = levels[k - 1]
                ones, twos = seen[col][k - 1] if seen else ((c == 1).sum(), (c == 2).sum())
                cut = ones / (ones + 2 * twos) if ones and twos else 0.5
                if k == 1:                                # interpolated with the uniform distribution
                    total, alphabet = c.sum(), letters_seen + 1
                    rest = cut * len(c) / total if total else 1.0
                    p = np.full(len(hashes[0]), rest / alphabet)
                    p[np.searchsorted(hashes[0], gram)] += np.maximum(c - cut, 0) / max(total, 1)
                    prob[0][:, col] = p
                    continue
                context, where, kinds = np.unique(gram >> np.uint64(16), return_inverse=True, return_counts=True)
                total = np.bincount(where, c)
                gamma = cut * kinds / total
                lower = np.searchsorted(hashes[k - 2], context)
                at = np.minimum(lower, len(hashes[k - 2]) - 1)
                found = hashes[k - 2][at] == context
                back[k - 2][at[found], col] = gamma[found]
                own = hashes[k - 1]
                # in a shard, contexts of other shards' grams may lack a tail: they are never scored here
                tail = np.minimum(np.searchsorted(hashes[k - 2], _last(own, k - 1)), len(hashes[k - 2]) - 1)
                head = np.minimum(np.searchsorted(hashes[k - 2], own >> np.uint64(16)), len(hashes[k - 2]) - 1)
                known = hashes[k - 2][head] == own >> np.uint64(16)
                p = np.where(known, back[k - 2][head, col], 1.0) * prob[k - 2][tail, col]
                p[np.searchsorted(own, gram)] += np.maximum(c - cut, 0) / total[where]
                prob[k - 1][:, col] = p
        with np.errstate(divide="ignore"):
            model = cls(langs, hashes, [np.log2(np.maximum(p, 1e-12)).astype(np.float32) for p in prob],
                        [np.log2(np.maximum(x, 1e-12)).astype(np.float32) for x in back])
        model.floor = np.float32(-np.log2(max(2, letters_seen + 1)) * 1.5)
        return model

    def scores(self, grams: np.ndarray) -> np.ndarray:
        """log2 probability of each gram's last character in each language."""
        order = len(self.hashes)
        out = np.empty((len(grams), len(self.langs)), np.float32)
        left = np.arange(len(grams))
        for k in range(order, 0, -1):
            part = _last(grams[left], k)
            at = np.minimum(np.searchsorted(self.hashes[k - 1], part), len(self.hashes[k - 1]) - 1)
            hit = self.hashes[k - 1][at] == part
            rows = left[hit]
            out[rows] = self.logp[k - 1][at[hit]]
            if k < order:
                out[rows] += weight[hit]
            left = left[~hit]
            if not len(left):
                return out
            weight = weight[~hit] if k < order else np.zeros((len(left), len(self.langs)), np.float32)
            if k > 1:                                     # the context of the next lower order backs off
                context = _last(grams[left], k) >> np.uint64(16)
                at = np.minimum(np.searchsorted(self.hashes[k - 2], context), len(self.hashes[k - 2]) - 1)
                seen = self.hashes[k - 2][at] == context
                weight[seen] += self.back[k - 2][at[seen]]
        out[left] = weight + self.floor
        return out

    def cross_entropy(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character (documents x languages) and scored characters of each document."""
        order = len(self.hashes)
        bits, length = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for s, e in spans([len(t or b"") for t in texts], CHUNK_BYTES // 2):
            chars, n = letters(texts[s:e])
            same, owner = _inside(n, order)
            grams, owner = packed(chars, order)[same], owner[same]
            if not len(grams):
                continue
            value = self.scores(grams)
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            bits[s + owner[first]] = -np.add.reduceat(value.astype(np.float64), first, axis=0)
            length[s:e] = np.bincount(owner, minlength=e - s)
        short = np.flatnonzero(length == 0)
        for i in short:                                   # too short for a whole gram: what there is, by the lower orders
            chars, n = letters([texts[i]])
            if n[0] > 2:
                grams = packed(np.concatenate((np.full(order - 1, SPACE, np.uint32), chars)), order)[order - 1:]
                bits[i], length[i] = -self.scores(grams).sum(axis=0), len(grams)
        return bits / np.maximum(length, 1)[:, None], length


def _last(grams: np.ndarray, k: int) -> np.ndarray:
    return grams & np.uint64((1 << 16 * k) - 1) if k < 4 else grams


def _middle(grams: np.ndarray) -> np.ndarray:
    """The third and second character of each top-order gram, by which shards are cut."""
    return (grams >> np.uint64(16) & np.uint64(0xFFFF)) << np.uint64(16) | grams >> np.uint64(32) & np.uint64(0xFFFF)


@dataclass
class Model:
    """Shards (first middle, end, broadcast ``KneserNey``); one shard is the whole model."""
    langs: list[str]
    shards: list[tuple]

    def cross_entropy(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.shards) == 1:
            return self.shards[0][2].value.cross_entropy(texts)
        bits, length = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        parts = []
        for s, e in spans([len(t or b"") for t in texts], CHUNK_BYTES // 2):
            chars, n = letters(texts[s:e])
            same, owner = _inside(n, ORDER)
            parts.append((packed(chars, ORDER)[same], s + owner[same]))
            length += np.bincount(parts[-1][1], minlength=len(texts))
        for first, end, sent in self.shards:
            part = sent.load_from_path(sent._path) if sent._path else sent.value      # not kept, as .value is
            for grams, owner in parts:
                mine = (_middle(grams) >= first) & (_middle(grams) < end)
                own = owner[mine]
                if len(own):
                    at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                    bits[own[at]] -= np.add.reduceat(part.scores(grams[mine]).astype(np.float64), at, axis=0)
        return bits / np.maximum(length, 1)[:, None], length


def _by_language(pdf, size: int, names: tuple[str, str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each language its sorted grams and their counts."""
    col, gram, n = pdf["col"].to_numpy(), pdf[names[0]].to_numpy(np.int64).view(np.uint64), pdf[names[1]].to_numpy(np.int64)
    order = np.lexsort((gram, col))
    ends = np.searchsorted(col[order], np.arange(size + 1))
    return [(gram[order[s:e]], n[order[s:e]]) for s, e in zip(ends[:-1], ends[1:])]


def fit(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", max_grams: int = MAX_GRAMS) -> Model:
    """Model from all grams of all rows with a lang.  Shards of at most ``max_grams`` grams by
    four languages (a pair of middle characters is never split)."""
    spark = docs.sparkSession
    counts = written(gram_counts(docs, lang_col, text_col), "langid-grams")
    sizes = {r["lang"]: r["k"] for r in counts.groupBy("lang").agg(F.count(F.lit(1)).alias("k")).collect()}
    langs = sorted(sizes, key=lambda x: x.encode())
    size, room = len(langs), 4 * max_grams // max(1, len(langs))
    if not langs:
        return Model([], [])
    cols = spark.createDataFrame([(x, i) for i, x in enumerate(langs)], "lang string, col int")
    counts = counts.join(F.broadcast(cols), "lang").drop("lang")      # one row a language
    if sum(sizes.values()) <= room:
        rows = _by_language(counts.toPandas(), size, ("gram", "n"))
        return Model(langs, [(0, 1 << 32, spark.sparkContext.broadcast(KneserNey.fit(langs, [g for g, _ in rows], [n for _, n in rows])))])
    char = lambda place: F.shiftrightunsigned("gram", 16 * place).bitwiseAND(F.lit(0xFFFF))
    counts = written(counts.withColumn("middle", F.shiftleft(char(1), 16).bitwiseOR(char(2)))
                     .repartitionByRange("middle").sortWithinPartitions("middle"), "langid-shards")
    levels = [counts]
    for k in (3, 2, 1):
        low = levels[0].groupBy("col", F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels.insert(0, written(low, f"langid-order-{k}"))
    seen = [[(0, 0)] * ORDER for _ in langs]
    for k, level in enumerate(levels):
        for r in level.groupBy("col").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect():
            seen[r["col"]][k] = r["ones"], r["twos"]
    kinds = counts.groupBy("middle").agg(F.count(F.lit(1)).alias("k")).toPandas().sort_values("middle")     # one row a pair of characters
    cuts = [int(kinds["middle"].iloc[s]) for s, _ in spans(kinds["k"].tolist(), room)] + [1 << 32]
    ones = _by_language(levels[0].toPandas(), size, ("gram", "n"))
    shards = []
    for first, end in zip([0, *cuts[1:-1]], cuts[1:]):
        twos = levels[1].where(char(1).between(first >> 16, (end - 1) >> 16)).toPandas()
        rows = _by_language(counts.where((F.col("middle") >= first) & (F.col("middle") < end)).toPandas(), size, ("gram", "n"))
        part = KneserNey.fit(langs, [g for g, _ in rows], [n for _, n in rows], lower=list(zip(ones, _by_language(twos, size, ("gram", "n")))), seen=seen)
        shards.append((first, end, spark.sparkContext.broadcast(part)))
    return Model(langs, shards)


def _together(batches, limit: int):
    """Batches joined until their texts have ``limit`` bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column("_text").nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def predict(docs: DataFrame, model: Model, limits: dict[str, tuple[float, float]] | None = None, *, text_col: str = "text",
            keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``lang_pred, score, bits, chars, rejected``.  score is the
    posterior of the chosen language under equal priors, with the characters' evidence
    counted up to 200 characters."""
    spark = docs.sparkSession
    small_batches(spark)
    m, limits = model, dict(limits or {})

    def run(batches):
        for b in _together(batches, HELD_BYTES if len(m.shards) > 1 else 0):
            b = pa.Table.from_batches(b).combine_chunks()
            texts = b.column("_text").to_pylist()
            k = len(texts)
            lang, score, bits, rejected = ["und"] * k, np.zeros(k), [None] * k, np.ones(k, bool)
            length = np.zeros(k, np.int64)
            if m.langs:
                entropy, length = m.cross_entropy(texts)
                best = entropy.argmin(axis=1)
                low = entropy[np.arange(k), best]
                odds = np.exp2(-(entropy - low[:, None]) * np.minimum(length, 200)[:, None])
                post = 1 / odds.sum(axis=1)
                for i in np.flatnonzero(length):
                    name = m.langs[best[i]]
                    lang[i], score[i], bits[i] = name, post[i], float(low[i])
                    middle, most = limits.get(name, (0.0, np.inf))
                    rejected[i] = (low[i] - middle) * np.sqrt(min(length[i], STEADY) / STEADY) > most
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c).combine_chunks() for c in keep], pa.array(lang), pa.array(score), pa.array(bits, pa.float64()), pa.array(length), pa.array(rejected)],
                [*keep, "lang_pred", "score", "bits", "chars", "rejected"])
    src = docs.select(*keep, F.col(text_col).cast("binary").alias("_text"))
    schema = docs.select(*keep).schema
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("bits", "double"), ("chars", "long"), ("rejected", "boolean")):
        schema = schema.add(name, kind)
    return src.mapInArrow(run, schema)


def calibrate(docs: DataFrame, model: Model, *, text_col: str = "text", keep: float = 0.999, slack: float = 1.0) -> dict[str, tuple[float, float]]:
    """Per language the median bits per character and the excess over it (for ``STEADY``
    characters) beyond which a document is rejected, over all documents given."""
    found = written(predict(docs, model, text_col=text_col, keep=()).where("chars > 0").select("lang_pred", "bits", "chars"), "langid-calibration")
    middle = found.groupBy("lang_pred").agg(F.percentile_approx("bits", F.lit(0.5), F.lit(10_000)).alias("m"))
    excess = (F.col("bits") - F.col("m")) * F.sqrt(F.least(F.col("chars"), F.lit(STEADY)) / F.lit(STEADY))
    most = (found.join(F.broadcast(middle), "lang_pred").groupBy("lang_pred")      # one row a language
            .agg(F.first("m").alias("m"), F.percentile_approx(excess, F.lit(keep), F.lit(10_000)).alias("q")))
    return {r["lang_pred"]: (r["m"], r["q"] + slack) for r in most.collect()}


def identify(docs: DataFrame, *, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text",
             keep: tuple[str, ...] | None = None) -> DataFrame:
    """Train on the documents of crc32 folds 1 to 3, calibrate on fold 4, predict all.
    Adds ``held_out`` (fold 0, never learned from).  Languages, ids and sources are no
    input of a prediction."""
    fold = fold_of(id_col)
    model = fit(docs.where(fold.isin(1, 2, 3)), lang_col=lang_col, text_col=text_col)
    limits = calibrate(docs.where((fold == 4) & F.col(lang_col).isNotNull()), model, text_col=text_col)
    keep = keep or (id_col,)
    return predict(docs.withColumn("held_out", fold == 0), model, limits, text_col=text_col, keep=(*keep, "held_out"))
