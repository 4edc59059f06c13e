"""Splits: contiguous k folds (F1) and seeded hash splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .indexing import assign_folds, with_row_index  # noqa: F401  (F1 lives in indexing)


def hash_order(key_col: str, seed: int):
    """Deterministic pseudo-random order: md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key_col).cast("string")))


def train_dev_test_split(df: DataFrame, key_col: str, test_frac: float = 0.3,
                         seed: int = 42, split_col: str = "split") -> DataFrame:
    """shuffle split, ``ceil(test_frac * n)`` rows held out, the hold-out
    halved into dev / test (test gets the larger half).  Order by md5(seed‖key),
    cut at exact counts computed from a distributed row index."""
    n = df.count()
    n_hold = -(-int(round(test_frac * n * 1e9)) // int(1e9))  # ceil without float noise
    n_test = -(-n_hold // 2)
    idx = with_row_index(df.withColumn("_h", hash_order(key_col, seed)), ["_h", key_col], "_r")
    return (idx.withColumn(split_col,
                           F.when(F.col("_r") < n_test, "test")
                            .when(F.col("_r") < n_hold, "dev")
                            .otherwise("train"))
               .drop("_h", "_r"))
