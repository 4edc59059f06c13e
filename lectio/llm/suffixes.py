"""Removal of byte strings that occur more than once, by deep-shallow suffix sorting.

A byte goes if a string of ``length`` bytes that covers it also starts at another place of
any document.  Suffixes are compared to ``length`` bytes only, so only starts that share
their first bytes with another start need sorting:

1. *Anchors.*  In every window of ``length`` bytes the ``GRAM``-byte gram with the smallest
   hash is the window's anchor; equal windows have equal anchors at the same place.  Spark
   counts anchors (about one in 150 bytes); windows of an anchor that occurs once are done.
2. *Runs.*  Consecutive starts with one repeated anchor are a run, cut at fixed distances from
   the anchor, so that all windows of a run share a core of at least ``length - STEP`` bytes.
   Runs are grouped by the hash of that core.  Equal runs are counted and carried as one
   entry with the number of its copies, so copies cost one row each and nothing more.
3. *Suffix sorting.*  In each group of different runs the suffixes are ordered: multikey
   quicksort on eight bytes a step to the shallow depth ``SHALLOW``; the groups that still
   agree go into blind tries, which compare every member with one leaf, branch at the first
   different byte and go on below it.  Suffixes that reach one leaf at depth ``length`` are
   the same string.  A core with very many different runs is not sorted in one task:
   its windows are counted by 128-bit hashes, spread over the cluster.
4. Repeated starts become byte ranges of their documents, which are cut out.

Rules for odd rows: null text is empty; texts shorter than ``length`` keep all; rows that
repeat are documents of their own (each is a copy of the other); extra columns are not
used; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, small_batches, written

LENGTH = 400
GRAM = 100
STEP = 101                       # starts of a run at most
SHALLOW = 32
ANCHOR_BROADCAST = 4_000_000     # repeated anchors (8 bytes each) up to which tasks get them all; beyond, they are joined
BUCKET_BYTES = 2_000_000         # bytes of runs sorted together
HEAVY_CORE = 4_000               # different runs of a core beyond which its windows are hashed instead

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each place: rolling polynomial, then mixed."""
    up, down = _powers(len(text))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[text] * up, dtype=np.uint64)))
    h = (total[gram:] - total[:-gram]) * down[:len(text) - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def anchors(text: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start its anchor's place (leftmost smallest hash), and all hashes."""
    h = gram_hashes(text, gram)
    w = length - gram + 1
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    padded = np.full(-(-len(key) // w) * w, np.uint64(2**64 - 1))
    padded[:len(key)] = key
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(key) - w + 1
    low = np.minimum(right[:n], left[w - 1:w - 1 + n])
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64), h


def _first_of_runs(at: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))


def runs_of(text: bytes, known, length: int, gram: int) -> list[tuple[int, int, int, int, int]]:
    """(core hash, run hash, first start, last start, distance of the first start from its
    anchor) of the runs whose anchor ``known`` accepts."""
    import xxhash
    at, h = anchors(np.frombuffer(text, np.uint8), length, gram)
    first = _first_of_runs(at)
    first = first[known(at[first], h[at[first]])]
    if not len(first):
        return []
    ends = _first_of_runs(at)
    last = np.append(ends[1:], len(at))[np.searchsorted(ends, first)] - 1
    out = []
    for s, e, p in zip(first.tolist(), last.tolist(), at[first].tolist()):
        while s <= e:
            j = (p - s) // STEP                              # distances [j * STEP, j * STEP + STEP) lie together
            t = min(e, p - j * STEP)
            far = min(length - gram, j * STEP + STEP - 1)
            core = xxhash.xxh3_64_intdigest(text[p - j * STEP:p - far + length], seed=j)
            out.append((core, xxhash.xxh3_64_intdigest(text[s:t + length], seed=p - s), s, t, p - s))
            s = t + 1
    return out


# ---- deep-shallow sorting of one bucket

def _words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a big-endian number (zeros beyond the end)."""
    b = np.concatenate((buf, np.zeros(8, np.uint8))).astype(np.uint64)
    out = np.zeros(len(buf), np.uint64)
    for i in range(8):
        out |= b[i:i + len(buf)] << np.uint64(56 - 8 * i)
    return out


def _grouped(order_keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Sort by the keys (first key first): the order, and a group number for equal keys, per place in that order."""
    order = np.lexsort(order_keys[::-1])
    new = np.zeros(len(order), bool)
    for k in order_keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new)


def _shared(pos: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leave out the groups of one (group numbers ascend)."""
    size = np.bincount(group)
    keep = size[group] > 1
    return pos[keep], group[keep]


def deep_shallow_classes(buf: np.ndarray, pos: np.ndarray, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Classes of two or more starts in ``pos`` whose ``length`` bytes are equal, as parts of
    (places in ``pos``, class number within the part).  ``buf`` holds ``length`` bytes from each."""
    words = _words(buf)
    tail = np.uint64(0xFFFFFFFFFFFFFFFF) << np.uint64(8 * (-length % 8))     # of the last, partly used word
    steps = -(-length // 8)

    def word(p, i):
        return words[p + 8 * i] if i < steps - 1 or length % 8 == 0 else words[p + 8 * i] & tail
    idx, group = np.arange(len(pos)), np.zeros(len(pos), np.int64)
    for i in range(min(SHALLOW // 8, steps)):                # multikey quicksort, eight bytes a step
        order, g = _grouped((group, word(pos[idx], i)))
        idx, group = _shared(idx[order], g)
        if not len(idx):
            return []
    depth = np.full(len(idx), min(SHALLOW // 8, steps), np.int64)   # words known to agree within the group
    out, number = [], 0
    while len(idx):                                          # blind tries of all groups, a level at a time
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        leaf = np.repeat(idx[first], np.diff(np.append(first, len(idx))))
        agree = depth.copy()
        alive = np.flatnonzero(agree < steps)
        while len(alive):                                    # common prefix with the leaf
            a, b, d = pos[idx[alive]], pos[leaf[alive]], agree[alive]
            x, y = words[a + 8 * d], words[b + 8 * d]
            if length % 8:
                cut = d == steps - 1
                x, y = np.where(cut, x & tail, x), np.where(cut, y & tail, y)
            same = x == y
            alive = alive[same]
            agree[alive] += 1
            alive = alive[agree[alive] < steps]
        full = agree == steps
        if full.any():
            members, g = _shared(idx[full], np.unique(group[full], return_inverse=True)[1])
            if len(members):
                out.append((members, g + number))
                number += int(g[-1]) + 1
        idx, group, agree = idx[~full], group[~full], agree[~full]
        if not len(idx):
            break
        branch = words[pos[idx] + 8 * agree]                 # the first different word tells the branches apart
        if length % 8:
            branch = np.where(agree == steps - 1, branch & tail, branch)
        order, g = _grouped((group, agree, branch))
        keep = np.bincount(g)[g] > 1
        idx, depth, group = idx[order][keep], agree[order][keep] + 1, g[keep]
    return out


def repeated_spans(runs: list[bytes], copies: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each different run, the ranges (first, last) of its starts whose string occurs again."""
    size = np.array([len(r) for r in runs], np.int64)
    starts = size - length + 1
    base = np.concatenate(([0], np.cumsum(size)[:-1]))
    owner = np.repeat(np.arange(len(runs)), starts)
    first = np.cumsum(starts) - starts
    pos = np.arange(len(owner)) - np.repeat(first, starts) + np.repeat(base, starts)
    again = copies[owner] > 1
    for members, _ in deep_shallow_classes(np.frombuffer(b"".join(runs), np.uint8), pos, length):
        again[members] = True
    out: list[list[tuple[int, int]]] = [[] for _ in runs]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], again, [False])).astype(np.int8)))
    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
        while s < e:                                         # a stretch may pass from one run to the next
            o = owner[s]
            t = min(e, int(first[o] + starts[o]))
            out[o].append((s - int(first[o]), t - 1 - int(first[o])))
            s = t
    return out


SPANS = "array<struct<a:int,b:int>>"


def _sorted_spans(entries: DataFrame, length: int) -> DataFrame:
    """``core, run, spans`` of the entries (core, run, n, bytes), by suffix sorting in buckets of whole cores."""
    size = entries.agg(F.sum(F.length("bytes"))).first()[0] or 0
    buckets = int(max(1, -(-size // BUCKET_BYTES)))

    def order(pdf):
        import pandas as pd
        pdf = pdf.sort_values(["core", "run"])
        found = repeated_spans([bytes(b) for b in pdf["bytes"]], pdf["n"].to_numpy(), length)
        hit = [i for i, f in enumerate(found) if f]
        return pd.DataFrame({"core": pdf["core"].to_numpy()[hit], "run": pdf["run"].to_numpy()[hit],
                             "spans": pd.Series([[{"a": a, "b": b} for a, b in found[i]] for i in hit], dtype=object)})
    return (entries.withColumn("bucket", F.pmod(F.xxhash64("core"), F.lit(buckets)).cast("int"))
            .groupBy("bucket").applyInPandas(order, f"core long, run long, spans {SPANS}"))


def _hashed_spans(entries: DataFrame, length: int) -> DataFrame:
    """The same for cores with very many different runs: windows counted by 128-bit hashes."""
    def windows(batches):
        import xxhash
        for b in batches:
            for core, run, n, data in zip(*(b.column(c).to_pylist() for c in ("core", "run", "n", "bytes"))):
                k = len(data) - length + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([core] * k), pa.array([run] * k), pa.array([n] * k), pa.array(range(k), pa.int32()),
                     pa.array([xxhash.xxh3_128_digest(data[i:i + length]) for i in range(k)])], ["core", "run", "n", "at", "window"])
    rows = entries.select("core", "run", "n", "bytes").mapInArrow(windows, "core long, run long, n long, at int, window binary")
    again = rows.groupBy("window").agg(F.sum("n").alias("total")).where("total > 1").select("window")
    return (rows.join(again, "window").groupBy("core", "run")
            .agg(F.transform(F.sort_array(F.collect_set("at")), lambda x: F.struct(x.alias("a"), x.alias("b"))).cast(SPANS).alias("spans")))


def repeated_ranges(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``_rid, ranges``: byte ranges (start, end) that the repeated strings cover, not yet merged."""
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(row_key(id_col, text_col).alias("_rid"), F.col(text_col).cast("binary").alias("_text")).where(F.length("_text") >= length)

    def list_anchors(batches):
        for b in batches:
            out = []
            for text in b.column("_text").to_pylist():
                at, h = anchors(np.frombuffer(text, np.uint8), length, gram)
                out.append(h[at[_first_of_runs(at)]].view(np.int64))
            flat = np.concatenate(out) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat)], ["anchor"])
    twice = (src.select("_text").mapInArrow(list_anchors, "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("anchor"))
    twice = written(twice, "anchors")
    if twice.count() <= ANCHOR_BROADCAST:
        all_known = np.sort(twice.toPandas()["anchor"].to_numpy(np.int64)).view(np.int64)
        sent = spark.sparkContext.broadcast(all_known)
        work = src.withColumn("_at", F.lit(None).cast("array<int>"))
    else:
        sent = None

        def place_anchors(batches):
            for b in batches:
                places, hashes = [], []
                for text in b.column("_text").to_pylist():
                    at, h = anchors(np.frombuffer(text, np.uint8), length, gram)
                    p = at[_first_of_runs(at)]
                    places.append(p.astype(np.int32))
                    hashes.append(h[p].view(np.int64))
                n = [len(p) for p in places]
                rid = b.column("_rid").take(pa.array(np.repeat(np.arange(len(n)), n)))
                yield pa.RecordBatch.from_arrays([rid, pa.array(np.concatenate(hashes)), pa.array(np.concatenate(places))], ["_rid", "anchor", "at"])
        places = src.mapInArrow(place_anchors, "_rid binary, anchor long, at int").join(twice, "anchor", "left_semi")
        work = src.join(places.groupBy("_rid").agg(F.collect_set("at").alias("_at")), "_rid")

    def list_runs(batches):
        seen: set[tuple[int, int]] = set()
        for b in batches:
            rid, rows, data = [], [], []
            for i, (text, at) in enumerate(zip(b.column("_text").to_pylist(), b.column("_at").to_pylist())):
                if at is not None:
                    mine = np.sort(np.array(at, np.int64))
                    found = runs_of(text, lambda p, h, mine=mine: np.isin(p, mine), length, gram)
                else:
                    def known(p, h):
                        x = h.view(np.int64)
                        j = np.searchsorted(sent.value, x)
                        return (j < len(sent.value)) & (sent.value[np.minimum(j, len(sent.value) - 1)] == x) if len(sent.value) else np.zeros(len(x), bool)
                    found = runs_of(text, known, length, gram)
                rid += [i] * len(found)
                for core, run, s, e, _ in found:
                    new = (core, run) not in seen
                    if new:
                        seen.add((core, run))
                        if len(seen) > 500_000:                  # bytes of a run are sent once a task, or a little more often
                            seen.clear()
                    data.append(text[s:e + length] if new else None)
                rows += found
            core, run, s, e, _ = np.array(rows, np.uint64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [b.column("_rid").take(pa.array(rid, pa.int64())), pa.array(core.copy().view(np.int64)), pa.array(run.copy().view(np.int64)),
                 pa.array(s.astype(np.int32)), pa.array(data, pa.binary())], ["_rid", "core", "run", "start", "bytes"])
    runs = written(work.mapInArrow(list_runs, "_rid binary, core long, run long, start int, bytes binary"), "runs", "zstd")
    # a run's length follows from its bytes, which at least one row of each task holds
    copies = written(runs.groupBy("core", "run").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("bytes")).alias("size")), "run-copies")
    cores = copies.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total")).where("total > 1")
    alike = copies.join(cores.where("kinds = 1").select("core"), "core").select(
        "core", "run", F.array(F.struct(F.lit(0).alias("a"), (F.col("size") - length).cast("int").alias("b"))).cast(SPANS).alias("spans"))
    mixed = copies.join(cores.where("kinds > 1").select("core", "kinds"), "core")
    entries = written(runs.where("bytes is not null").select("core", "run", "bytes").join(mixed.select("core", "run", "n", "kinds"), ["core", "run"])
                      .groupBy("core", "run").agg(F.first("bytes").alias("bytes"), F.first("n").alias("n"), F.first("kinds").alias("kinds")), "run-entries")
    spans = alike.unionByName(_sorted_spans(entries.where(F.col("kinds") <= HEAVY_CORE), length))
    if entries.where(F.col("kinds") > HEAVY_CORE).limit(1).count():
        spans = spans.unionByName(_hashed_spans(entries.where(F.col("kinds") > HEAVY_CORE), length))
    found = runs.select("_rid", "core", "run", "start").join(spans, ["core", "run"])
    one = F.explode(F.transform("spans", lambda x: F.struct((F.col("start") + x["a"]).alias("s"), (F.col("start") + x["b"] + length).alias("e"))))
    return found.select("_rid", one.alias("x")).groupBy("_rid").agg(F.collect_set("x").alias("ranges"))


def cut_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes left), one row per document."""
    ranges = repeated_ranges(docs, id_col=id_col, text_col=text_col, length=length, gram=gram)
    def pack(batches):                                       # texts cross the shuffle compressed
        import zstandard
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_rid"), pa.array([z.compress(t) for t in b.column("_text").to_pylist()], pa.binary())],
                                             ["doc_id", "_rid", "_text"])
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("_rid"),
                      F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("_text"))
    src = src.mapInArrow(pack, "doc_id long, _rid binary, _text binary").join(ranges, "_rid", "left")

    def cut(batches):
        import zstandard
        z = zstandard.ZstdDecompressor()
        for b in batches:
            total, gone, spans, kept = [], [], [], []
            for packed, found in zip(b.column("_text").to_pylist(), b.column("ranges").to_pylist()):
                text = z.decompress(packed)
                left, at, merged = [], 0, 0
                for s, e in sorted((x["s"], x["e"]) for x in found or ()):
                    if s > at or not merged:
                        merged += 1
                        left.append(text[at:s])
                    at = max(at, e)
                left.append(text[at:])
                rest = b"".join(left)
                total.append(len(text))
                gone.append(len(text) - len(rest))
                spans.append(merged)
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(x, pa.int64()) for x in (total, gone, spans)], pa.array(kept, pa.binary())],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
    return src.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")

