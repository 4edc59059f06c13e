"""Nearest neighbours by collision counting over sorted one-dimensional projections.

Queries are scaled to unit length, which changes no order.  Data are split into bands of similar length
(a factor of ``BAND``) and a band into blocks.  Inside a band largest inner product
becomes smallest distance by one more coordinate (data: ``sqrt(M^2 - |x|^2)`` with M the band's greatest
length, queries: 0), so one long vector does not flatten the others.  In a block each of ``projections``
random lines has the block's projections as one sorted array.  For a query, windows
centred at its own projections are widened step by step (virtual rehashing: radius times
``grow``), only what a step adds is counted, and a vector that collides on at least
``threshold`` of the lines is verified by its exact inner product.  Widening ends when the
k-th best verified vector lies within the radius, or when ``k + share * block`` vectors
have been verified; a block of up to ``4 k`` vectors is verified whole.

The longest bands, with ``FIRST`` of all vectors, are searched first.  The k-th score found
there sends a query on only to bands whose length times its own can exceed it, and ends its
widening there as soon as nothing better can lie outside.

Equal vectors are one entry with the smallest ``k + 1`` of their ids, so a vector that
fills a third of the table costs what any other does, and queries are searched once for
each different vector.  Queries meet the data block by block.

Rules for odd rows: vectors that are null, empty, zero or hold null or non-finite components
take no part, neither as query nor as candidate; vectors are compared with those of their own
length only; rows repeating an id are one row; null ids take no part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

DATA_BLOCK = 16_384
QUERY_BLOCK = 4_096
SAMPLE = 512        # vectors of a block from which a query's first radius is read
MARGIN = 1.06       # the radius must be this much over the k-th best distance found
BAND = 1.25         # lengths in a band differ by less than this factor
FIRST = 0.1         # share of the vectors, the longest ones, that gives a query its first k-th score


def random_lines(dim: int, count: int, seed: int) -> np.ndarray:
    """``count`` directions as columns, orthogonal in groups of ``dim``, as long as Gaussian ones."""
    rng = np.random.default_rng(seed)
    groups = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-count // dim))]
    return np.concatenate(groups, axis=1)[:, :count] * np.sqrt(dim)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with ``b``, summed in component order."""
    return np.cumsum(a * b, axis=1)[:, -1]


class Projections:
    """A block's vectors with their sorted projections."""

    def __init__(self, data: np.ndarray, top: float, projections: int, seed: int):
        self.data = data
        lift = np.sqrt(np.maximum(top - (data * data).sum(axis=1), 0.0))
        self.lines = random_lines(data.shape[1] + 1, projections, seed)
        values = data @ self.lines[:-1] + lift[:, None] * self.lines[-1]
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(values, self.order.T, axis=0).T.copy()
        # a vector's place on every line: counts a wide window by two comparisons instead of a scattered sum
        self.place = np.empty(self.order.shape, np.uint16 if len(data) <= 1 << 16 else np.uint32)
        np.put_along_axis(self.place, self.order, np.arange(len(data), dtype=self.place.dtype)[None, :], axis=1)
        self.top = top

        # a bounded sample from which a query's first radius is read
        self.sample = data[np.random.default_rng(seed + 1).permutation(len(data))[:SAMPLE]]

    def search(self, q: np.ndarray, k: int, threshold: float, width: float, grow: float, share: float,
               floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Places in the block of the verified vectors and their inner products with ``q``, a unit
        vector; ``floor``: a score of which k are known elsewhere."""
        n, m = len(self.data), len(self.sorted)
        if n <= 4 * k:
            return np.arange(n), self.data @ q
        at = q @ self.lines[:-1]
        need, most = int(np.ceil(threshold * m)), k + int(share * n)
        base = self.top + q @ q                        # squared distance = base - 2 * inner product
        hits = np.zeros(n, np.int8 if m < 128 else np.int16)
        lo = [s.searchsorted(v) for s, v in zip(self.sorted, at)]
        hi = list(lo)
        checked, places, found = np.zeros(n, bool), np.zeros(0, np.int64), np.zeros(0)
        radius = np.sqrt(max(base - 2 * (self.sample @ q).max(), 0.0625 * base))
        while True:
            half = width * radius / 2
            for j in range(m):
                a, b = self.sorted[j].searchsorted((at[j] - half, at[j] + half))
                o = self.order[j]
                if lo[j] == hi[j] and 8 * (b - a) > n:
                    hits += (self.place[j] - self.place.dtype.type(a)) < self.place.dtype.type(b - a) if b - a < n else True
                elif lo[j] == hi[j]:
                    hits[o[a:b]] += 1
                else:
                    hits[o[a:lo[j]]] += 1
                    hits[o[hi[j]:b]] += 1
                lo[j], hi[j] = a, b
            new = np.flatnonzero((hits >= need) & ~checked)
            checked[new] = True
            places, found = np.concatenate((places, new)), np.concatenate((found, self.data[new] @ q))
            kth = max(floor, np.partition(found, len(found) - k)[len(found) - k] if len(found) >= k else -np.inf)
            if len(found) >= most or base - 2 * kth <= (radius / MARGIN) ** 2:
                return places, found
            radius *= grow


def usable(vec: Column) -> Column:
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(ok, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20,
            projections: int = 65, threshold: float = 0.76, width: float = 2.4, grow: float = 1.1, share: float = 0.2,
            seed: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row with ``is_query``: its ``k`` nearest others."""
    rows = vectors.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("double") + F.lit(0.0)).alias("vec"),
        F.coalesce(is_query, F.lit(False)).alias("asks")).withColumn("key", F.md5(F.to_json("vec").cast("binary")))
    rows = written(rows, "vectors")
    # the k + 1 smallest ids of each different vector: limited in each task before the shuffle
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("r") <= k + 1)
    items = ranked.groupBy("key").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_set("id")).alias("ids")).withColumn("dim", F.size("vec"))
    # half a band further on, so that unit vectors, a little longer or shorter by rounding, share one
    # the greatest component is a column of its own: it scales the squares against overflow, and is taken once a vector
    items = items.withColumn("top", F.array_max(F.transform("vec", lambda x: F.abs(x))))
    squares = F.aggregate("vec", F.lit(0.0), lambda a, x: a + (x / F.col("top")) * (x / F.col("top")))
    items = items.withColumn("length", F.col("top") * F.sqrt(squares)).drop("top").withColumn("band", F.floor(F.log("length") / np.log(BAND) + 0.5))
    items = written(items, "vector-items")
    asked = rows.where("asks").select("key").distinct()
    bands = sorted(items.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("most")).collect(), key=lambda r: -r["band"])
    n, first, seen = sum(r["n"] for r in bands), [], 0
    while len(first) < len(bands) and (not first or seen < FIRST * n):
        seen += bands[len(first)]["n"]
        first.append(bands[len(first)]["band"])
    queries = items.join(asked, "key", "left_semi").select(*[F.col(c).alias(c) for c in ("key", "dim", "vec", "length")])
    asks = max(1, -(-asked.count() // QUERY_BLOCK))
    part = lambda col, parts: F.pmod(F.xxhash64(col), parts).cast("int")
    if not bands:
        return items.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    table = F.array(*[F.struct(F.lit(r["band"]).cast("long").alias("band"), F.lit(max(1, -(-r["n"] // DATA_BLOCK))).alias("blocks"),
                               F.lit(float(r["most"])).alias("most")) for r in bands])
    own = F.filter(table, lambda t: t["band"] == F.col("band"))[0]
    data = items.withColumn("own", own).select("*", "own.blocks", "own.most").withColumn("b", part("key", F.col("blocks")))
    data = data.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(asks - 1)))).select("key", "vec", "ids", "dim", "band", "b", "q", "most")
    queries = queries.withColumn("q", part("key", F.lit(asks)))

    def search(group, have, want):
        import pandas as pd
        out = []
        if len(have) and len(want):
            have = have.sort_values("key")
            most = float(have["most"].iloc[0])
            raw = np.stack(have["vec"].to_numpy())
            index = Projections(raw / most, 1.0, projections, seed)
            ids = have["ids"].to_list()
            for key, vec, length, floor in zip(want["key"], want["vec"], want["length"], want["floor"]):
                at, score = index.search(np.asarray(vec) / length, k + 1, threshold, width, grow, share, floor / most)
                if len(at) > k + 1:                       # ties with the last one, and what rounding may hide, stay
                    last = np.partition(score, len(at) - k - 1)[len(at) - k - 1]
                    at = at[score >= last - 1e-9 * (1 + abs(last))]
                score = inner(raw[at], np.asarray(vec))
                best = sorted((-s, i) for s, a in zip(score.tolist(), at.tolist()) for i in ids[a])[:k + 1]
                out.append(pd.DataFrame({"key": key, "vec_id": [i for _, i in best], "score": [-s for s, _ in best]}))
        return pd.concat(out) if out else pd.DataFrame({"key": pd.Series([], dtype=str), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    def best_of(found):
        order = [F.col("score").desc(), F.col("vec_id")]
        ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("r") <= k + 1)
        return written(ranked.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near")), "vector-found")

    def searched(asking, chosen):
        able = F.filter(table, lambda t: t["band"].isin(chosen) & (t["most"] >= F.col("floor")))
        spread = asking.withColumn("t", F.explode(able)).select(*[F.col(c).alias(c) for c in ("key", "vec", "length", "floor", "dim", "q")], "t.*")
        spread = spread.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "most")
        groups = ["band", "b", "q", "dim"]
        found = (data.where(F.col("band").isin(chosen)).groupBy(*groups).cogroup(spread.groupBy(*groups))
                 .applyInPandas(search, "key string, vec_id long, score double"))
        return best_of(found)

    best = searched(queries.withColumn("floor", F.lit(float("-inf"))), first)
    if len(first) < len(bands):
        # scores relative to the unit query; rounding is allowed for
        known = best.select("key", F.when(F.size("near") > k, F.element_at("near", k + 1)["score"]).alias("kth"))
        floor = F.coalesce(F.col("kth") / F.col("length") - F.lit(1e-9) * F.abs(F.col("kth") / F.col("length")), F.lit(float("-inf")))
        rest = searched(queries.join(known, "key", "left").withColumn("floor", floor).drop("kth"), [r["band"] for r in bands[len(first):]])
        both = best.unionByName(rest).select("key", F.explode("near").alias("x")).select("key", "x.vec_id", "x.score")
        best = best_of(both)
    mine = rows.where("asks").select("key", F.col("id").alias("query_id")).distinct().join(best, "key")
    others = mine.select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return others.select("query_id", F.posexplode("near").alias("p", "x")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
