"""Line dedup: sharded cuckoo filters in front of exact reference-count tables.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z
lower-cased; only keys of at least ``min_chars`` code points count.  The index keeps

* ``postings``: one row per document with the 16-byte hashes of its keys,
* ``counts``: exact reference counts (key, documents holding it, largest doc_id),
* ``filters``: per shard of the key space a cuckoo filter of the keys held by at least
  ``min_docs`` documents.

Lines are first asked of the filters (a few bytes a key); what may be repeated is joined
with the exact counts, so false positives change nothing.  ``insert`` and ``delete``
apply count differences and add to or delete from the filters only the keys that crossed
``min_docs``; deleting what was inserted brings back the earlier index.

Rules for odd rows: null or empty text is one empty line; a null doc_id counts as a
document smaller than all others; repeated rows are documents of their own (they share
a doc_id, so the largest one keeps its line in each of them); extra columns are passed
through, but columns named n_lines or n_dropped are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key, small_batches, written

SPACE = b" \t\n\x0b\x0c\r"
SLOTS = 4                                # fingerprints per bucket
KICKS = 500                              # moves before a filter is built anew at twice the size
FILTER_BROADCAST_BYTES = 64 << 20        # filters beyond this are not sent to tasks; the exact join alone decides


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """16-byte hash of a line's key, or None if the key is too short."""
    import xxhash
    line = line.strip(SPACE)
    if len(line) < min_chars:
        return None
    if len(line) < 4 * min_chars and not line.isascii() and len(line.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(line.lower())


class CuckooFilter:
    """16-bit fingerprints, four to a bucket, two buckets a key; supports deletion."""

    def __init__(self, buckets: int, cells: np.ndarray | None = None):
        self.mask = buckets - 1
        self.cells = np.zeros((buckets, SLOTS), np.uint16) if cells is None else cells

    @classmethod
    def sized_for(cls, n: int) -> "CuckooFilter":
        buckets = 4
        while buckets * SLOTS * 0.85 < n:
            buckets *= 2
        return cls(buckets)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        tail = int.from_bytes(key[8:], "little")
        mark = (tail & 0xFFFF) or 1
        one = (tail >> 16) & self.mask
        return mark, one, one ^ ((mark * 0x5BD1E995 >> 7) & self.mask)

    def add(self, key: bytes) -> bool:
        mark, one, two = self._places(key)
        at = one
        for turn in range(KICKS):
            for b in ((one, two) if turn == 0 else (at,)):
                free = np.flatnonzero(self.cells[b] == 0)
                if len(free):
                    self.cells[b, free[0]] = mark
                    return True
            slot = turn % SLOTS
            mark, self.cells[at, slot] = int(self.cells[at, slot]), mark
            at ^= (mark * 0x5BD1E995 >> 7) & self.mask
        return False

    def remove(self, key: bytes) -> None:
        mark, one, two = self._places(key)
        for b in (one, two):
            hit = np.flatnonzero(self.cells[b] == mark)
            if len(hit):
                self.cells[b, hit[0]] = 0
                return


def _filled(keys: list[bytes], start: int = 0) -> CuckooFilter:
    n = max(len(keys), start)
    while True:
        f = CuckooFilter.sized_for(n)
        if all(f.add(k) for k in keys):
            return f
        n *= 2


class Probe:
    """All shards' filters as one array, asked for many keys at once."""

    def __init__(self, rows: list[tuple[int, bytes]], shards: int):
        self.shards = shards
        self.offset, self.mask = np.zeros(shards, np.int64), np.zeros(shards, np.int64)
        parts, total = [np.zeros((1, SLOTS), np.uint16)], 1
        for shard, blob in rows:
            cells = np.frombuffer(blob, np.uint16).reshape(-1, SLOTS)
            self.offset[shard], self.mask[shard] = total, len(cells) - 1
            parts.append(cells)
            total += len(cells)
        self.cells = np.concatenate(parts)

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        """keys: n x 2 uint64 (little-endian halves of the hashes)."""
        shard = (keys[:, 0] % np.uint64(self.shards)).astype(np.int64)
        mark = (keys[:, 1] & np.uint64(0xFFFF)).astype(np.int64)
        mark[mark == 0] = 1
        one = (keys[:, 1] >> np.uint64(16)).astype(np.int64) & self.mask[shard]
        two = one ^ ((mark * 0x5BD1E995 >> 7) & self.mask[shard])
        m = mark.astype(np.uint16)[:, None]
        return ((self.cells[self.offset[shard] + one] == m) | (self.cells[self.offset[shard] + two] == m)).any(axis=1)


@dataclass(frozen=True)
class LineIndex:
    postings: DataFrame      # _rid, doc_id, keys array<binary>
    counts: DataFrame        # key, n, top
    filters: DataFrame       # shard, cells
    shards: int
    min_docs: int
    min_chars: int


def line_postings(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            out = []
            for text in b.column("_text").to_pylist():
                keys = {line_key(x, min_chars) for x in text.split(b"\n")} if text and len(text) >= min_chars else set()
                keys.discard(None)
                out.append(sorted(keys))
            yield pa.RecordBatch.from_arrays([b.column("_rid"), b.column("doc_id"), pa.array(out, pa.list_(pa.binary()))],
                                             ["_rid", "doc_id", "keys"])
    src = docs.select(row_key(id_col, text_col).alias("_rid"), F.col(id_col).cast("long").alias("doc_id"),
                      F.col(text_col).cast("binary").alias("_text"))
    return src.mapInArrow(run, "_rid binary, doc_id long, keys array<binary>")


def _counted(postings: DataFrame, sign: int = 1) -> DataFrame:
    return (postings.select("doc_id", F.explode("keys").alias("key")).groupBy("key")
            .agg((F.count(F.lit(1)) * sign).alias("n"), F.max("doc_id").alias("top")))


def _shard(shards: int):
    # low 8 bytes of the hash, little-endian, as numpy reads them
    half = F.reverse(F.hex(F.substring("key", 1, 8)))       # nibbles reversed ...
    pairs = F.regexp_replace(half, "(.)(.)", "$2$1")         # ... and put right within each byte
    low = F.conv(F.substring(pairs, 9, 8), 16, 10).cast("decimal(38,0)")
    high = F.conv(F.substring(pairs, 1, 8), 16, 10).cast("decimal(38,0)")
    return ((high * F.lit(1 << 32) + low) % F.lit(shards)).cast("int")


def _build_filters(counts: DataFrame, min_docs: int, shards: int) -> DataFrame:
    def build(pdf):
        import pandas as pd
        cells = _filled([bytes(k) for k in pdf["key"]]).cells
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "cells": [cells.tobytes()]})
    hot = counts.where(F.col("n") >= min_docs).select("key", _shard(shards).alias("shard"))
    return hot.groupBy("shard").applyInPandas(build, "shard int, cells binary")


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                min_docs: int = 5, keys_per_shard: int = 50_000) -> LineIndex:
    postings = written(line_postings(docs, id_col, text_col, min_chars), "line-postings")
    counts = written(_counted(postings), "line-counts")
    hot = counts.where(F.col("n") >= min_docs).count()
    shards = max(16, -(-hot // keys_per_shard))
    return LineIndex(postings, counts, written(_build_filters(counts, min_docs, shards), "line-filters"),
                     shards, min_docs, min_chars)


def _changed(index: LineIndex, counts: DataFrame) -> DataFrame:
    """Filters after the counts changed: only keys that crossed ``min_docs`` are added or deleted."""
    was = index.counts.where(F.col("n") >= index.min_docs).select("key", F.lit(True).alias("was"))
    now = counts.where(F.col("n") >= index.min_docs).select("key", F.lit(True).alias("now"))
    moved = (was.join(now, "key", "full").where("was is null or now is null")
             .select("key", F.col("now").isNotNull().alias("add"), _shard(index.shards).alias("shard")))

    def apply(key, old, new):
        import pandas as pd
        shard = int(key[0])
        f = None
        if len(old):
            cells = np.frombuffer(old["cells"].iloc[0], np.uint16).reshape(-1, SLOTS).copy()
            f = CuckooFilter(len(cells), cells)
        else:
            f = CuckooFilter.sized_for(len(new))
        for k in new.loc[~new["add"].astype(bool), "key"] if len(new) else []:
            f.remove(bytes(k))
        ok = all(f.add(bytes(k)) for k in (new.loc[new["add"].astype(bool), "key"] if len(new) else []))
        return pd.DataFrame({"shard": [shard], "cells": [f.cells.tobytes() if ok else None]})
    filters = written(index.filters.groupBy("shard").cogroup(moved.groupBy("shard"))
                      .applyInPandas(apply, "shard int, cells binary"), "line-filters")
    if filters.where("cells is null").limit(1).count():      # a full shard: all are built anew at their new sizes
        filters = written(_build_filters(counts, index.min_docs, index.shards), "line-filters")
    return filters


def insert(index: LineIndex, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
    new = written(line_postings(docs, id_col, text_col, index.min_chars), "line-postings")
    counts = written(index.counts.unionByName(_counted(new)).groupBy("key")
                     .agg(F.sum("n").alias("n"), F.max("top").alias("top")), "line-counts")
    return replace(index, postings=index.postings.unionByName(new), counts=counts, filters=_changed(index, counts))


def delete(index: LineIndex, ids: DataFrame, *, id_col: str = "doc_id") -> LineIndex:
    """Delete all documents with the given ids.  Largest ids are looked up anew only for
    the keys that lost theirs."""
    ids = ids.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    gone = index.postings.join(ids, "doc_id", "left_semi")
    left = written(index.postings.join(ids, "doc_id", "left_anti").select("_rid", "doc_id", "keys"), "line-postings")
    less = _counted(gone, -1).select("key", F.col("n").alias("d"), F.col("top").alias("lost"))
    counts = index.counts.join(less, "key", "left").withColumn("n", F.col("n") + F.coalesce("d", F.lit(0))).where("n > 0")
    stale = counts.where("lost = top").select("key")
    tops = (left.select("doc_id", F.explode("keys").alias("key")).join(stale, "key", "left_semi")
            .groupBy("key").agg(F.max("doc_id").alias("found")))
    counts = counts.join(tops, "key", "left").select(
        "key", "n", F.when(F.col("lost") == F.col("top"), F.col("found")).otherwise(F.col("top")).alias("top"))
    counts = written(counts, "line-counts")
    return replace(index, postings=left, counts=counts, filters=_changed(index, counts))


def repeated_postings(index: LineIndex) -> DataFrame:
    """``_rid, doc_id, key`` of the lines that the filters do not rule out."""
    spark: SparkSession = index.postings.sparkSession
    size = index.filters.agg(F.sum(F.length("cells"))).first()[0] or 0
    if size > FILTER_BROADCAST_BYTES:
        return index.postings.select("_rid", "doc_id", F.explode("keys").alias("key"))
    probe = spark.sparkContext.broadcast(Probe([(r["shard"], bytes(r["cells"])) for r in index.filters.collect()], index.shards))

    def run(batches):
        for b in batches:
            lists = b.column("keys")
            flat = lists.flatten()
            if not len(flat):
                continue
            keys = flat.to_pylist()
            hit = np.flatnonzero(probe.value.maybe(np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)))
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))[hit]
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("_rid").take(row), b.column("doc_id").take(row), flat.take(pa.array(hit))],
                                             ["_rid", "doc_id", "key"])
    return index.postings.mapInArrow(run, "_rid binary, doc_id long, key binary")


def dedup_lines(docs: DataFrame, index: LineIndex | None = None, *, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with the kept lines as text, and ``n_lines, n_dropped``.

    Lines whose key is held by at least ``min_docs`` documents stay only in the largest
    doc_id holding it.  ``index`` covers ``docs``; without it one is built."""
    index = index or build_index(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, min_docs=min_docs)
    small_batches(docs.sparkSession)
    limit = index.min_chars
    hot = index.counts.where(F.col("n") >= index.min_docs).select("key", "top")
    drops = (repeated_postings(index).join(hot, "key")
             .where("top is not null and (doc_id is null or doc_id < top)")
             .groupBy("_rid").agg(F.collect_set("key").alias("_drop")))
    docs = docs.drop("n_lines", "n_dropped")
    src = docs.withColumn("_rid", row_key(id_col, text_col)).join(drops, "_rid", "left").drop("_rid")
    names = list(docs.columns)
    schema = docs.schema.add("n_lines", "long").add("n_dropped", "long")

    def run(batches):
        for b in batches:
            texts, dropped = b.column(text_col).cast(pa.binary()).to_pylist(), b.column("_drop").to_pylist()
            kept, lines, lost = [], [], []
            for text, drop in zip(texts, dropped):
                n = 0
                total = text.count(b"\n") + 1 if text else 1
                if drop:
                    drop = set(drop)
                    stay = [x for x in text.split(b"\n") if line_key(x, limit) not in drop]
                    n = total - len(stay)
                    text = b"\n".join(stay)
                kept.append(text)
                lines.append(total)
                lost.append(n)
            cols = [pa.array(kept, pa.binary()).cast(b.schema.field(c).type) if c == text_col else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(lost, pa.int64())],
                                             [*names, "n_lines", "n_dropped"])
    return src.mapInArrow(run, schema)
