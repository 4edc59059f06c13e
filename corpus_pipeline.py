"""The corpus pipeline: documents through five operators, each stage written and reread.

Every stage takes ``(spark, docs, sf_dir)``.  All but the last return the columns of
``docs``; the last one adds how often the mix takes a document.  Rows with nulls, empty
or repeated texts are handled as the operators' docstrings say; extra columns are carried
along, and columns that an operator adds under the same name stay the input's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio.llm.common import table, written
from lectio.llm.decontaminate import find_leaks
from lectio.llm.langid import identify
from lectio.llm.line_dedup import dedup_lines
from lectio.llm.mixing import mix
from lectio.llm.simhash import near_duplicates

SHINGLE, MAX_BITS = 3, 3


def _key(docs: DataFrame):
    """16-byte identity of a whole row; rows equal in every column share it."""
    parts = []
    for f in docs.schema.fields:
        c = F.col(f"`{f.name}`")
        c = F.to_json(F.struct(c)) if f.dataType.typeName() in ("array", "map", "struct", "variant") else c.cast("binary" if f.dataType.typeName() == "binary" else "string")
        parts.append(F.coalesce(F.md5(c.cast("binary")), F.lit("-")))
    return F.unhex(F.md5(F.concat_ws(",", *parts).cast("binary"))).alias("key")


def _packed(docs: DataFrame, *more) -> DataFrame:
    """The row as one struct column, so that its column names meet no others."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *more)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go (no letters, or unlike every language)."""
    rows = _packed(docs, "doc_id", "lang", "text")
    return identify(rows, keep=("doc",)).where(~F.col("rejected")).select("doc.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a changed text gets its new length."""
    rows = _packed(docs, "doc_id", "text")
    out = dedup_lines(rows)
    changed = F.col("n_dropped") > 0
    fields = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[F.when(changed, fields[c].cast(docs.schema[c].dataType)).otherwise(F.col(f"doc.`{c}`")).alias(c)
                        if c in fields else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays: the smallest doc_id (nulls
    last), and of rows equal in every column one."""
    rows = _packed(docs, _key(docs), "doc_id", "text")
    groups = near_duplicates(rows.withColumnRenamed("doc_id", "own_id"), id_col="key", shingle=SHINGLE, max_bits=MAX_BITS, keep=("own_id",))
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("own_id").isNull().alias("no_id"), "own_id", F.col("doc_id").alias("key"))).alias("best"))
    return (rows.select("doc", "key").dropDuplicates(["key"])
            .join(first.select(F.col("best.key").alias("key")), "key", "left_semi").select("doc.*"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    rows = _packed(docs, _key(docs), "text")
    found = find_leaks(rows, table(spark, sf_dir, "benchmark"), keep=("key",)).select("key").distinct()
    return rows.select("doc", "key").join(found, "key", "left_anti").select("doc.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with ``copies``, ``taken`` (words) and the source's
    ``target``.  Rows equal in every column are one row with their copies added up."""
    rows = _packed(docs, _key(docs), "doc_id", "source", "text")
    took = (mix(rows, keep=("key",)).where("copies > 0").groupBy("key")
            .agg(F.sum("copies").alias("copies"), F.first("target").alias("target"), F.sum("taken").alias("taken")))
    names = [c for c in docs.columns if c not in ("copies", "target", "taken")]
    return (rows.select("doc", "key").dropDuplicates(["key"]).join(took, "key")
            .select(*[F.col(f"doc.`{c}`").alias(c) for c in names], "copies", "target", "taken"))


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash_near_dedup", near_copies),
          ("decontamination", leaks), ("source_mixing", mixture)]

#: Language models, fingerprints and alignments have no SQL form: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
