"""Joins and checks that prepare the modelling table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_responses_text(responses: DataFrame, texts: DataFrame, key: str = "survey_num") -> DataFrame:
    """Full outer join of responses and article texts on the article key.
    Both sides are large in general, so this is a shuffle join on the key."""
    return responses.join(texts, key, "full_outer")


def lookup_join(df: DataFrame, lookup: DataFrame, key: str, value: str,
                lookup_key: str | None = None, on_missing: str = "null") -> DataFrame:
    """Dictionary lookup as a join.

    The join's strategy is left to adaptive execution, which broadcasts the
    lookup side only from its measured bytes.
    ``on_missing='raise'`` reproduces the dictionary's KeyError as a checked
    violation count; ``'null'`` keeps the row with a null value.
    """
    lk = lookup_key or key
    lt = lookup.select(F.col(lk).cast(df.schema[key].dataType).alias(key), F.col(value))
    out = df.join(lt, key, "left")
    if on_missing == "raise":
        expect(out, F.col(value).isNotNull() | F.col(key).isNull(), f"lookup of {key} -> {value}")
    return out


def violations(df: DataFrame, rule: str, ok: Column) -> DataFrame:
    """One-row frame (rule, violations) counting rows where ``ok`` is not true."""
    return df.agg(F.sum(F.when(ok, 0).otherwise(1)).cast("long").alias("violations")) \
             .select(F.lit(rule).alias("rule"), F.coalesce("violations", F.lit(0)).alias("violations"))


def expect(df: DataFrame, ok: Column, rule: str) -> None:
    """Raise when any row violates ``ok`` (one aggregate pass)."""
    n = violations(df, rule, ok).first()["violations"]
    if n:
        raise AssertionError(f"data check failed: {rule}: {n} rows")


def union_checks(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def stack_features(df: DataFrame, key: str, feature_cols: list[str], emb: DataFrame,
                   emb_key: str, emb_col: str, out_col: str = "features") -> DataFrame:
    """Key-join a vector (array) column and concatenate it after the
    numeric features into one array column.  Never positional."""
    e = emb.select(F.col(emb_key).alias(key), F.col(emb_col).alias("_emb"))
    base = F.array(*[F.col(c).cast("double") for c in feature_cols])
    return (df.join(e, key, "left")
              .withColumn(out_col, F.concat(base, F.transform("_emb", lambda x: x.cast("double"))))
              .drop("_emb"))


#: A key is hot when it holds more than this share of the rows; fewer than 1/share keys can be.
HOT_SHARE = 1 / 50_000


#: A lookup table estimated at up to so many bytes is broadcast whole.
LOOKUP_BYTES = 64 << 20


def join_by_key(rows: DataFrame, lookup: DataFrame, keys: list[str], count_col: str, total: int,
                lookup_bytes: int | None = None, reread: bool = False, limit: int | None = None) -> DataFrame:
    """Left join of ``rows`` with ``lookup`` (one row per key, ``count_col`` = how many of the
    ``total`` rows hold it; all its columns are added, null where there is none).  Hot keys
    are broadcast, at most 50,000 of them; only rows of other keys are shuffled by key, hot
    rows are spread by their content, so no key's rows meet in one task.  Null keys match nothing.
    A lookup whose estimated ``lookup_bytes`` are up to LOOKUP_BYTES is broadcast whole.
    ``reread``: ``rows`` are cheap to compute twice; rows of hot keys are then not shuffled at all.
    ``limit``: keys with more rows than that are hot; the caller answers for their size."""
    names = [c for c in lookup.columns if c not in keys]
    if lookup_bytes is not None and lookup_bytes <= LOOKUP_BYTES:
        return rows.join(F.broadcast(lookup), keys, "left").select(*rows.columns, *names)
    limit = F.lit(int(total * HOT_SHARE) if limit is None else limit)
    packed = lookup.select(*keys, F.struct(*names).alias("_v"), F.col(count_col).alias("_n"))
    hot = packed.where(F.col("_n") > limit).drop("_n").withColumnRenamed("_v", "_hot")
    cold = packed.where(F.col("_n") <= limit).drop("_n").withColumnRenamed("_v", "_cold").withColumn("_spread", F.lit(-1))
    stay = None
    if reread:
        stay = rows.join(F.broadcast(hot), keys).select(*rows.columns, *[F.col("_hot")[c].alias(c) for c in names])
        got = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").withColumn("_hot", F.lit(None).cast(hot.schema["_hot"].dataType))
    else:
        got = rows.join(F.broadcast(hot), keys, "left")
    away = F.shiftrightunsigned(F.xxhash64(*[F.col(c) for c in rows.columns]), 33).cast("int")
    apart = F.col("_hot").isNotNull()
    for k in keys:
        apart = apart | F.col(k).isNull()
    got = got.withColumn("_spread", F.when(apart, away).otherwise(F.lit(-1)))
    got = got.join(cold, [*keys, "_spread"], "left")
    both = F.coalesce("_hot", "_cold")
    got = got.select(*rows.columns, *[both[c].alias(c) for c in names])
    return got if stay is None else stay.unionByName(got)
