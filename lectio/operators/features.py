"""Article features (T3, T4) and one-hot encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialised
from .indexing import with_row_index
from .prep import join_by_key
from .surprisal import corpus_counts, exploded, join_counts


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Word, syllable, sentence and distinct-word counts and their ratios.

    Ratios are integer counts divided last, so they are exact and engine
    independent.  Everything is a per-row expression: no shuffle.
    """
    words = T.word_tokens(text_col)
    base = docs.select(
        id_col,
        F.size(words).cast("long").alias("num_words"),
        T.syllable_count(text_col).alias("n_syllables"),
        T.sentence_count(text_col).alias("n_sentences"),
        F.size(F.array_distinct(F.transform(words, lambda w: F.lower(w)))).cast("long").alias("n_unique"))
    return base.select(
        "*",
        T.safe_div("n_syllables", "num_words").alias("syll_per_word"),
        T.safe_div("num_words", "n_sentences").alias("words_per_sent"),
        T.safe_div("n_unique", "num_words").alias("unique"))


def word_frequency_feature(docs: DataFrame, id_col: str = "doc_id",
                           text_col: str = "text") -> DataFrame:
    """T3 ``freq``: mean corpus relative frequency of a document's words.

    Words meet their corpus counts where they lie (frequent words by a bounded
    broadcast), and the sums are aggregated in every task before the shuffle.
    """
    words = exploded(docs, id_col, T.word_tokens(text_col))
    counted = corpus_counts(words)
    per_doc = join_counts(words, counted).groupBy(id_col).agg(
        F.sum(F.col("_c").cast("double")).alias("_num"), F.count(F.lit(1)).alias("_n"))
    return (docs.select(id_col).join(per_doc, id_col, "left")
                .select(id_col,
                        (F.col("_num") / (F.col("_n").cast("double") * F.lit(float(counted[1])))).alias("freq")))


def category_flags(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """T4: a category label and a 0/1 flag derived from its suffix (the
    reference's ``type`` / ``how_to`` pair; here ``source_lang`` and English)."""
    doc_type = F.concat_ws("_", F.col("source"), F.col("lang"))
    return docs.select(id_col, doc_type.alias("doc_type"),
                       doc_type.endswith("_en").cast("long").alias("is_en"))


def one_hot(df: DataFrame, cols: list[str] | None = None, max_categories: int = 10_000,
            keep: list[str] | None = None) -> DataFrame:
    """Replace every string column by 0/1 columns ``{col}_{value}``, one per
    distinct value in sorted order; a null gives all zeros.

    Categories are discovered with one distinct aggregate per column whose
    size is checked before it reaches the driver (a category list is a
    schema, not data).
    """
    if cols is None:
        cols = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    out_cols = [F.col(c) for c in df.columns if c not in cols]
    for c in cols:
        values = df.select(c).where(F.col(c).isNotNull()).distinct().limit(max_categories + 1).collect()
        if len(values) > max_categories:
            raise ValueError(f"one_hot: column {c} has more than {max_categories} categories")
        for v in sorted(r[0] for r in values):
            out_cols.append(F.when(F.col(c) == F.lit(v), F.lit(1)).otherwise(F.lit(0))
                            .cast("long").alias(f"{c}_{v}"))
    return df.select(*out_cols)


def category_index(df: DataFrame, col: str) -> DataFrame:
    """(``col``, ``n`` rows, ``index`` from 0 in sorted order) of a string column's distinct values."""
    values = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return materialised(with_row_index(values, col, "index").select(col, "n", "index"), "categories")


def one_hot_sparse(df: DataFrame, cols: list[str], out_col: str = "one_hot") -> DataFrame:
    """T6 for any number of categories: the string columns replaced by one sparse vector
    ``out_col`` (``size``, ``indices``, ``values``), laid out as ``one_hot`` orders its columns; a null has no
    entry.  Categories are a table that is joined (frequent ones by a bounded broadcast), never a
    schema or a list on the driver."""
    total, offset, parts = None, F.lit(0).cast("long"), []
    for c in cols:
        index = category_index(df, c)
        total = df.count() if total is None else total
        df = join_by_key(df, index.withColumnRenamed("n", f"_n_{c}").withColumnRenamed("index", f"_i_{c}"), [c], f"_n_{c}", total)
        parts.append(F.col(f"_i_{c}") + offset)
        offset = offset + F.lit(index.count())
    held = F.filter(F.array(*parts), lambda i: i.isNotNull())
    vector = F.struct(offset.alias("size"), held.alias("indices"), F.transform(held, lambda i: F.lit(1.0)).alias("values"))
    rest = [c for c in df.columns if c not in cols and not c.startswith(("_n_", "_i_"))]
    return df.select(*rest, vector.alias(out_col))
