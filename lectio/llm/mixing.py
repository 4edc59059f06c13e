"""Mixing sources to target weights by Pareto order sampling.

Every document has an expected number of copies ``e``: its source's target words over
its source's words (times an optional per-document rate), at most ``max_copies``.
``floor(e)`` copies are certain.  The fraction ``pi = e - floor(e)`` is an inclusion
probability: documents are ranked by ``(U / (1 - U)) / (pi / (1 - pi))`` for a hashed
uniform ``U``, and the lowest ranks are taken until the words still missing are filled,
so the sample size is fixed (in words) and the probabilities may differ by document.
One closing document, the one whose size comes nearest to the gap left, follows if it
brings the total nearer to the target.

Rules for odd rows: null text has size 0; null source is a source of its own, ordered
last; size 0 takes 0 words; rows that repeat are documents of their own; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.indexing import with_row_index
from .common import written

WORD = r"[^\x20\x09-\x0D]+"
SOURCE_BROADCAST_BYTES = 8 << 20     # tables of one row a source are broadcast up to this size, else joined by shuffle
_DENOM = float(1 << 52)


def uniform(seed: int, *cols: Column) -> Column:
    """A number in (0, 1) hashed from the columns: 52 bits of an md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / _DENOM


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_copies: float = 2.0) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, size``.

    Sources in code-point order (null last) get the weights in turn and share ``share``
    times all words; a target stops at ``max_copies`` times its source's words and what it
    leaves is shared again by weight.  Each round is one aggregate over the sources; only
    the common level (one number) reaches the driver."""
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    per = with_row_index(per.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "_i")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", turn.alias("_w"), (F.col("source_size") * float(max_copies)).alias("_cap"))
    total, weight = per.agg(F.sum("source_size"), F.sum("_w")).first()
    if not total:
        return per.select("source", "source_size", F.lit(0.0).alias("target"))
    level, full = total * share / weight, -1
    while True:
        at = F.col("_w") * F.lit(level) >= F.col("_cap")
        n, capped, rest = per.agg(F.sum(at.cast("int")), F.sum(F.when(at, F.col("_cap")).otherwise(0.0)),
                                  F.sum(F.when(at, 0.0).otherwise(F.col("_w")))).first()
        if n == full or not rest:
            break
        full, level = n, (total * share - capped) / rest
    target = F.when(at, F.col("_cap")).otherwise(F.col("_w") * F.lit(level))
    return per.select("source", "source_size", target.alias("target"))


def _rates(docs: DataFrame, max_copies: float) -> DataFrame:
    """Factor ``_c`` per source so that ``min(max_copies, _c * rate) * size`` sums to the target."""
    level = docs.groupBy("_key").agg(F.first("target").alias("target"),
                                     F.sum(F.col("rate") * F.col("size")).alias("_m"))
    level = level.select("_key", F.when(F.col("_m") > 0, F.col("target") / F.col("_m")).otherwise(0.0).alias("_c"))
    done = -1
    while True:
        at = F.col("rate") * F.col("_c") >= max_copies
        joined = docs.join(level, "_key")
        nxt = joined.groupBy("_key").agg(
            F.first("target").alias("target"), F.first("_c").alias("_c"), F.sum(at.cast("long")).alias("_n"),
            F.sum(F.when(at, F.col("size") * max_copies).otherwise(0.0)).alias("_full"),
            F.sum(F.when(at, 0.0).otherwise(F.col("rate") * F.col("size"))).alias("_m"))
        left = (F.col("target") - F.col("_full")) / F.col("_m")
        nxt = written(nxt.select("_key", "_n", F.when(F.col("_m") > 0, F.greatest("_c", left))
                                 .otherwise(F.col("_c")).alias("_c")), "mix-rates")
        n = nxt.agg(F.sum("_n")).first()[0] or 0
        level = nxt.select("_key", "_c")
        if n == done:
            return level
        done = n


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights=(5, 2, 1), share: float = 1.5, max_copies: float = 2.0, rate: Column | None = None,
        seed: int = 11, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id, size, source, source_size, target, copies, taken``
    and the columns named in ``keep``.  ``rate`` makes documents of a source differ in
    their expected copies (non-negative; null counts as 0)."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"),
                       uniform(seed, F.col(id_col)).alias("_u"),
                       (F.coalesce(rate.cast("double"), F.lit(0.0)) if rate is not None else F.lit(1.0)).alias("rate"),
                       *[F.col(c).alias(f"_keep_{c}") for c in keep])
    base = base.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")))
    base = written(base.withColumn("_row", F.monotonically_increasing_id()), "mix-docs")
    targets = source_targets(base, weights, share, max_copies).withColumn(
        "_key", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))).drop("source")
    few = (targets.agg(F.sum(F.length("_key") + 64)).first()[0] or 0) <= SOURCE_BROADCAST_BYTES
    by_source = F.broadcast if few else (lambda df: df)          # all tables below with one row a source at most
    docs_t = base.join(by_source(targets), "_key")
    if rate is None:
        c = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
        docs_t = docs_t.withColumn("_e", F.least(F.lit(float(max_copies)), c))
    else:
        docs_t = docs_t.join(by_source(_rates(docs_t, float(max_copies))), "_key").withColumn(
            "_e", F.least(F.lit(float(max_copies)), F.col("_c") * F.col("rate")))
    docs_t = docs_t.withColumn("_whole", F.floor("_e").cast("long")).withColumn("_pi", F.col("_e") - F.col("_whole"))
    # words that the certain copies leave, and the mean fraction, of each source
    per = docs_t.groupBy("_key").agg(
        F.first("target").alias("_t"), F.sum(F.col("_whole") * F.col("size")).alias("_sure"),
        F.count(F.when(F.col("_pi") > 0, 1)).alias("_n"), F.avg(F.when(F.col("_pi") > 0, F.col("_pi"))).alias("_mean"))
    per = written(per.select("_key", (F.col("_t") - F.col("_sure")).alias("_left"), "_n", "_mean"), "mix-left")
    biggest = per.agg(F.max("_n")).first()[0] or 0
    blocks = int(min(1 << 20, max(64, biggest // 20_000)))
    odds = (F.col("_u") / (1 - F.col("_u"))) * ((1 - F.col("_pi")) / F.col("_pi")) * (F.col("_mean") / (1 - F.col("_mean")))
    ranked = (docs_t.join(by_source(per), "_key").withColumn("_rank", F.when((F.col("_pi") > 0) & (F.col("size") > 0), odds / (1 + odds)))
              .withColumn("_block", F.least(F.floor(F.col("_rank") * blocks), F.lit(blocks - 1)).cast("int")))
    # two levels: running words over blocks of ranks, then over the one block where they reach the gap
    sums = ranked.where("_block is not null").groupBy("_key", "_block").agg(F.sum("size").alias("_s"), F.first("_left").alias("_left"))
    w = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    edge = (sums.withColumn("_before", F.coalesce(F.sum("_s").over(w), F.lit(0)))
            .where((F.col("_before") <= F.col("_left")) & (F.col("_before") + F.col("_s") > F.col("_left")))
            .select("_key", F.col("_block").alias("_edge"), "_before"))
    ranked = ranked.join(by_source(edge), "_key", "left")
    order = Window.partitionBy("_key").orderBy("_rank", "size", "_row").rowsBetween(Window.unboundedPreceding, 0)
    inside = (ranked.where("_block = _edge").withColumn("_run", F.col("_before") + F.sum("size").over(order))
              .where("_run <= _left").select("_row", F.lit(True).alias("_in")))
    chosen = ranked.join(inside, "_row", "left").withColumn(
        "_extra", F.col("_block").isNotNull() & (F.col("_edge").isNull() | (F.col("_block") < F.col("_edge"))
                                                 | F.coalesce("_in", F.lit(False))))
    chosen = written(chosen.select("_row", "_key", "doc_id", "source", "size", "source_size", "target", "_whole", "_rank",
                                   "_extra", "_left", *[f"_keep_{c}" for c in keep]), "mix-chosen")
    gap = chosen.groupBy("_key").agg((F.first("_left") - F.sum(F.when(F.col("_extra"), F.col("size")).otherwise(0))).alias("_gap"))
    near = chosen.where(~F.col("_extra") & F.col("_rank").isNotNull()).join(by_source(gap), "_key").withColumn("_miss", F.abs(F.col("_gap") - F.col("size")))
    last = (near.where("_miss < abs(_gap)").groupBy("_key").agg(F.min(F.struct("_miss", "_rank", "_row")).alias("_m"))
            .select(F.col("_m._row").alias("_row"), F.lit(True).alias("_last")))
    copies = F.col("_whole") + (F.col("_extra") | F.coalesce("_last", F.lit(False))).cast("long")
    return (chosen.join(last, "_row", "left").withColumn("copies", copies)
            .select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
                    *[F.col(f"_keep_{c}").alias(c) for c in keep]))
