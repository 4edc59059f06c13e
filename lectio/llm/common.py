"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Rows per Arrow batch for text columns: bounds a Python worker's memory
#: whatever the length of the documents around it.
TEXT_BATCH_ROWS = 256
#: Bytes of text that a vectorised step handles at once.
CHUNK_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size to ``rows`` (never raise it)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to a fresh folder under spark.checkpoint.dir and read it back:
    cuts the lineage with files that every executor sees."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(id_col: str, text_col: str) -> Column:
    """16-byte identity of a row from its id and whole text.  Rows equal in both are
    interchangeable and share it; null and empty are told apart."""
    one = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("-"))
    two = F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("-"))
    return F.unhex(F.md5(F.concat(one, F.lit(":"), two).cast("binary")))


def spans(sizes, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to about ``limit`` (one item at least)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
