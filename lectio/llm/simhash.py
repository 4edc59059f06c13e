"""SimHash near-dedup: fingerprints linked by a binary trie self-join.

A 64-bit fingerprint has a bit set where over half of the document's shingle hashes have
it.  Fingerprints within ``max_bits`` differing bits are linked.  Equal fingerprints are
one trie entry.  The join is split over the cluster by root subtrees: two fingerprints
with at most ``max_bits`` differing bits agree in one of ``max_bits + 1`` bit blocks, so
each is put once per block into the trie whose first levels are that block.  Inside such
a trie, pairs of nodes are walked down together from the pair (root, root), adding up the
bits in which their paths differ; a pair over the budget is cut off.  A trie that many
fingerprints share is split once more by the blocks of its remaining bits.  What leaves a
task is a spanning set of links (at most one per entry), never all pairs.

Rules for odd rows: null or empty text has fingerprint 0 and is linked like any other;
fewer words than a shingle make one shingle; repeated rows share a fingerprint; a null
doc_id takes part but is never a component's id unless all its ids are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .components import connected_components

SEED = 42
TRIE_ROWS = 40_000          # entries that a task's tries hold together, about
HEAVY_TRIE = 20_000         # a trie with more entries is split by the blocks of its other bits
PAIR_BATCH = 1_000_000      # node pairs walked at once


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The fingerprint of a whole text; words are runs without ``[\\x20\\x09-\\x0D]``."""
    import xxhash
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-shingle])).tolist()
    stops = (ends[shingle - 1:] - 1).tolist()
    h = xxhash.xxh64_intdigest
    n, ones = len(starts), np.zeros(64, np.int64)
    for at in range(0, n, 50_000):
        hashes = np.array([h(joined[s:e], SEED) for s, e in zip(starts[at:at + 50_000], stops[at:at + 50_000])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id`` (the id column), the columns ``keep`` and ``fp`` (the 64 bits as a signed
    long), one row per document."""
    small_batches(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias("doc_id"), *keep)
    names = kept.columns

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column("_text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(fps.view(np.int64))], [*names, "fp"])
    return (docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).cast("binary").alias("_text"))
            .mapInArrow(run, kept.schema.add("fp", "long")))


def trie_links(keys: np.ndarray, depth: int, max_bits: int) -> np.ndarray:
    """Spanning links (index pairs) among the sorted distinct ``keys`` within ``max_bits``
    differing bits, walking node pairs of their binary tries that start at ``depth``."""
    n = len(keys)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i
    links = []
    top = keys >> np.uint64(64 - depth) if depth else np.zeros(n, np.uint64)
    lo = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
    hi = np.concatenate((lo[1:], [n]))
    many = hi - lo > 1
    stack = [(depth, lo[many], hi[many], lo[many], hi[many], np.zeros(int(many.sum()), np.int8))]
    ones = {}
    while stack:
        d, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > PAIR_BATCH:
            for s in range(0, len(a0), PAIR_BATCH):
                stack.append((d, *[x[s:s + PAIR_BATCH] for x in (a0, a1, b0, b1, err)]))
            continue
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            x, y = a0[leaf], b0[leaf]
            near = (x != y) & (np.bitwise_count(keys[x] ^ keys[y]) <= max_bits)
            for i, j in zip(x[near].tolist(), y[near].tolist()):
                ri, rj = root(i), root(j)
                if ri != rj:
                    parent[max(ri, rj)] = min(ri, rj)
                    links.append((i, j))
            a0, a1, b0, b1, err = (x[~leaf] for x in (a0, a1, b0, b1, err))
        if not len(a0) or d == 64:
            continue
        if d not in ones:
            ones[d] = np.concatenate(([0], np.cumsum((keys >> np.uint64(63 - d)) & np.uint64(1)))).astype(np.int64)
        c = ones[d]
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        same = a0 == b0
        parts = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1),
                 tuple(x[~same] for x in (am, a1, b0, bm, err + 1))]
        new = [np.concatenate(x) for x in zip(*parts)]
        keep = (new[0] < new[1]) & (new[2] < new[3]) & (new[4] <= max_bits)
        stack.append((d + 1, *[x[keep].astype(x.dtype) for x in new]))
    return np.array(links, np.int64).reshape(-1, 2)


def _turned(fp: np.ndarray, order: list[int]) -> np.ndarray:
    """Fingerprints with their bits (63 first) put in the given order."""
    out = np.zeros(len(fp), np.uint64)
    for i, bit in enumerate(order):
        out |= ((fp >> np.uint64(bit)) & np.uint64(1)) << np.uint64(63 - i)
    return out


def _blocks(bits: list[int], n: int) -> list[list[int]]:
    return [list(x) for x in np.array_split(np.array(bits), n)]


def _value(bits: list[int]):
    """Column: the given bits of ``fp`` as a number (they are consecutive runs in practice)."""
    out = F.lit(0).cast("long")
    for i, bit in enumerate(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", bit).bitwiseAND(F.lit(1).cast("long")), len(bits) - 1 - i))
    return out


def linked(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """Spanning links ``a, b`` among the distinct fingerprints of ``fps`` (column ``fp``)."""
    blocks = _blocks(list(range(63, -1, -1)), max_bits + 1)
    # subtree id: block number, the block's value; second level: number and value of a block of the other bits
    rows = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("blk"), _value(x).alias("val")) for i, x in enumerate(blocks)])).alias("k")).select("fp", "k.blk", "k.val")
    sizes = written(rows.groupBy("blk", "val").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "trie-sizes")
    total, heavy = sizes.agg(F.sum("n"), F.count(F.when(F.col("n") > HEAVY_TRIE, 1))).first()
    if not total:
        return fps.sparkSession.createDataFrame([], "a long, b long")
    rows = rows.join(sizes, ["blk", "val"])
    second = {}
    subs = [F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("sval"))]
    rows = rows.withColumn("_heavy", F.col("n") > HEAVY_TRIE)
    if heavy:
        rest = {i: _blocks([b for b in range(63, -1, -1) if b not in set(x)], max_bits + 1) for i, x in enumerate(blocks)}
        second = {(i, j): y for i, ys in rest.items() for j, y in enumerate(ys)}
        deep = None
        for i, ys in rest.items():
            arr = F.array(*[F.struct(F.lit(j).alias("sub"), _value(y).alias("sval")) for j, y in enumerate(ys)])
            deep = F.when(F.col("blk") == i, arr) if deep is None else deep.when(F.col("blk") == i, arr)
        rows = rows.withColumn("s", F.explode(F.when(F.col("_heavy"), deep).otherwise(F.array(*subs))))
        total = total * (max_bits + 1)
    else:
        rows = rows.withColumn("s", subs[0])
    rows = rows.select("fp", "blk", F.col("s.sub").alias("sub"), F.col("val"), F.col("s.sval").alias("sval"))
    tasks = max(1, -(-int(total) // TRIE_ROWS))
    rows = rows.withColumn("task", F.pmod(F.xxhash64("blk", "val", "sub", "sval"), F.lit(tasks)).cast("int"))

    def walk(pdf):
        import pandas as pd
        out = []
        for (blk, sub), part in pdf.groupby(["blk", "sub"]):
            first = blocks[int(blk)] + (second[int(blk), int(sub)] if sub >= 0 else [])
            order = first + [b for b in range(63, -1, -1) if b not in set(first)]
            fp = part["fp"].to_numpy(np.int64).view(np.uint64)
            keys = _turned(fp, order)
            at = np.argsort(keys)
            pairs = trie_links(keys[at], len(first), max_bits)
            if len(pairs):
                back = fp[at].view(np.int64)
                out.append(pd.DataFrame({"a": back[pairs[:, 0]], "b": back[pairs[:, 1]]}))
        return pd.concat(out) if out else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    return rows.groupBy("task").applyInPandas(walk, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns ``keep``, ``fp, component_id``, one row per document;
    component_id is the smallest doc_id that links of at most ``max_bits`` bits reach."""
    fps = written(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, keep=keep), "simhash")
    entries = written(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-entries")
    roots = connected_components(linked(entries, max_bits))
    groups = entries.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = groups.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = groups.select("fp", "root").join(lows, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", *keep, "fp", "component_id")
