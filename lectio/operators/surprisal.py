"""Per-token table (T5) and per-document surprisal sums.

The reference reads token tables made by an external neural language model.
Here the same table shape (word, wlen, sentpos, surp) is produced from the
corpus itself: add-one smoothed unigram surprisal ``-log2 p(token)`` from
corpus counts (a groupBy with map-side partial aggregation, so very common
tokens do not concentrate rows), joined back to every token.  A table from an
external model can be read with ``sources.read_token_outputs`` instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import text as T
from ..session import materialised
from .indexing import dealt_zipped, group_sums, looked_up, running_total
from .prep import join_by_key

SENT_END_TOKEN = r"^[.!?]$"     # fixed value: a token that closes a sentence


#: Estimated bytes up to which a whole vocabulary is broadcast with its counts.
VOCABULARY_BYTES = 64 << 20
#: Beyond that only head words are: the most frequent words up to that size, and words that hold more than
#: 1/HEAD_WORDS of all tokens, of which there are fewer than HEAD_WORDS in any corpus, with at most HEAD_WORDS mean
#: token lengths of characters.
HEAD_WORDS = 50_000


def explode_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tok_pos 1-based, word) for every token of every text."""
    return (docs.select(id_col, F.posexplode(T.tokens(text_col)).alias("p", "word"))
                .select(id_col, (F.col("p") + 1).cast("long").alias("tok_pos"), "word"))


def sentence_lengths(toks) -> Column:
    """Tokens of each sentence, as an array.  They are read off a mask of one
    character per token ('e' for a closing mark) split after every 'e'."""
    # only a token that begins with a closing mark meets the regular expression
    closes = lambda t: F.ascii(t).isin(*map(ord, ".!?")) & t.rlike(SENT_END_TOKEN)
    mask = F.array_join(F.transform(toks, lambda t: F.when(closes(t), F.lit("e|")).otherwise(F.lit("x"))), "")
    return F.transform(F.filter(F.split(mask, r"\|"), lambda c: F.length(c) > 0),
                       lambda c: F.length(c).cast("long"))


def exploded(docs: DataFrame, id_col: str, words) -> DataFrame:
    """(id, ``_key``): the lower-cased words of an array column.  The outer explode keeps
    Spark from evaluating the array once more for a not-empty filter."""
    return (docs.select(id_col, F.explode_outer(words).alias("_w")).where("_w is not null")
                .select(id_col, F.lower("_w").alias("_key")))


def corpus_counts(words: DataFrame) -> tuple[DataFrame, int, int, int]:
    """Cached (``_key``, ``_c``) of the column ``_key``, and the numbers of words and of
    distinct words and the characters of the distinct words."""
    counts = words.groupBy("_key").agg(F.count(F.lit(1)).alias("_c")).persist()
    st = counts.agg(F.sum("_c"), F.count(F.lit(1)), F.sum(F.length("_key"))).first()
    return counts, st[0] or 0, st[1], st[2] or 0


def head_limit(counted: tuple, keys=("_key",), count_col: str = "_c") -> int:
    """Words (or other ``keys``) with more than so many places are head words: the most frequent ones that take up to
    VOCABULARY_BYTES together (by powers of two), and in any case those with more than 1/HEAD_WORDS of all places."""
    counts, n = counted[:2]
    power = F.floor(F.log2(F.col(count_col).cast("double"))).cast("int").alias("power")
    chars = sum((F.coalesce(F.length(k), F.lit(0)) for k in keys), F.lit(0))
    sizes = counts.groupBy(power).agg(F.sum(4 * chars + 48 * len(keys)).alias("size")).collect()    # at most 63 rows
    limit, held = n // HEAD_WORDS, 0
    for r in sorted(sizes, reverse=True):
        held += r["size"]
        if held > VOCABULARY_BYTES:
            break
        limit = min(limit, (1 << r["power"]) - 1)
    return limit


def join_counts(words: DataFrame, counted: tuple[DataFrame, int, int, int]) -> DataFrame:
    """Rows with a ``_key`` joined to ``_c``, their number in ``words``.  A vocabulary of checked size is broadcast.  A
    larger one is split: head words meet a broadcast table where they lie, and only
    the other words, none of which is frequent, are shuffled.  If all of those are single they need no join."""
    counts, n, distinct, chars = counted
    if 4 * chars + 48 * distinct <= VOCABULARY_BYTES:
        return words.join(F.broadcast(counts), "_key").select(*words.columns, "_c")
    limit = head_limit(counted)
    head = F.broadcast(counts.where(F.col("_c") > limit))
    if limit == 1:
        found = words.where(F.col("_key").isNotNull()).join(head, "_key", "left")
        return found.select(*words.columns, F.coalesce("_c", F.lit(1).cast("long")).alias("_c"))
    rest = words.join(head.select("_key"), "_key", "left_anti")
    return (words.join(head, "_key").select(*words.columns, "_c")
            .unionByName(rest.join(counts.where(F.col("_c") <= limit), "_key").select(*words.columns, "_c")))


def _scored(toks: DataFrame, counted, id_col: str, pos_col: str, word_col: str) -> DataFrame:
    denom = float(counted[1] + counted[2])
    return join_counts(toks.withColumn("_key", F.lower(F.col(word_col))), counted).select(
        id_col, pos_col, word_col, F.length(word_col).cast("long").alias("wlen"), "sentpos",
        (-F.log2((F.col("_c") + 1).cast("double") / F.lit(denom))).alias("surp"))


def token_table(tokens: DataFrame, id_col: str, pos_col: str = "tok_pos",
                word_col: str = "word", block: int | None = 4096) -> DataFrame:
    """T5 on an exploded token frame: adds wlen, sentpos, surp.

    ``sentpos`` is the 1-based position in the sentence; a sentence ends at a
    token of terminal punctuation.  It is a running maximum in two levels, so a
    document of any size is spread over blocks of ``block`` tokens.  Where the
    tokens of a document are one array, ``array_token_table`` needs no window.
    """
    counted = corpus_counts(tokens.select(F.lower(F.col(word_col)).alias("_key")))
    ends = tokens.withColumn("_end", F.when(F.col(word_col).rlike(SENT_END_TOKEN), F.col(pos_col)))
    ends = running_total(ends, [id_col], pos_col, "_end", "_last_end", block=block, how="max")
    toks = ends.select(id_col, pos_col, word_col, (F.col(pos_col) - F.col("_last_end")).cast("long").alias("sentpos"))
    return _scored(toks, counted, id_col, pos_col, word_col)


def array_token_table(docs: DataFrame, id_col: str, tokens_col: str = "tokens") -> DataFrame:
    """T5 on one row per document with its tokens in order: the same table as
    ``token_table``, with sentence positions taken inside the row."""
    counted = corpus_counts(exploded(docs, id_col, tokens_col))
    sentpos = F.flatten(F.transform(sentence_lengths(F.col(tokens_col)), lambda n: F.sequence(F.lit(1).cast("long"), n)))
    # Positions stay an array beside the exploded tokens: not built where no one reads them.  The outer
    # explode keeps Spark from evaluating the tokens once more for a not-empty filter.
    toks = (docs.select(id_col, tokens_col, sentpos.alias("_sp"))
                .select(id_col, "_sp", F.posexplode_outer(tokens_col).alias("_p", "word")).where("_p is not null")
                .select(id_col, (F.col("_p") + 1).cast("long").alias("tok_pos"), "word", F.get("_sp", F.col("_p")).alias("sentpos")))
    return _scored(toks, counted, id_col, "tok_pos", "word")


START = "<s>"   # fixed value: predecessor of a document's first token


def bigram_table(docs: DataFrame, id_col: str, tokens_col: str = "tokens") -> DataFrame:
    """T5, bigram variant: ``surp = -log2((c(v, w) + 1) / (c(v) + V))`` with v
    the previous token of the same document (``<s>`` for the first), counts
    over the corpus (lower-cased), V the vocabulary size.  The previous token
    comes from the document's array; c(v) joins the pair table, so the tokens
    are joined once, on (v, w): the most frequent pairs where they lie, by a bounded broadcast,
    and only the others are shuffled, from a second tokenising pass.  Pairs and tokens are shuffled compressed."""
    low = F.concat(F.array(F.lit(START)), F.transform(tokens_col, lambda w: F.lower(w)))
    # What is done for a token is kept small, or the generated code is too large for the JVM to compile.
    toks = (docs.select(id_col, tokens_col, low.alias("_low"))
                .select(id_col, "_low", F.posexplode_outer(tokens_col).alias("_p", "word")).where("_p is not null")
                .select(id_col, (F.col("_p") + 1).cast("long").alias("tok_pos"), "word",
                        F.get("_low", F.col("_p")).alias("prev"), F.get("_low", F.col("_p") + 1).alias("_key")))
    # written, not kept in memory: many pairs would go to disk uncompressed
    ones = toks.select("prev", "_key", F.lit(1).cast("long").alias("_cvw"))
    fields = StructType([*ones.schema.fields, StructField("_cvw_n", LongType())])
    counted = dealt_zipped([(ones, ["prev", "_key"], "_cvw")], ["prev", "_key"], fields)
    pairs = materialised(group_sums(counted.sortWithinPartitions("prev", "_key"), ["prev", "_key"], "_cvw"), "bigram-pairs")
    n_voc = pairs.select("_key").distinct().count()
    after = materialised(pairs.groupBy("prev").agg(F.sum("_cvw").alias("_cv"), F.count(F.lit(1)).alias("_after")), "bigram-firsts")
    size = after.agg(F.coalesce(F.sum("_after"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.length("prev")), F.lit(0))).first()
    surp = -F.log2((F.col("_cvw") + 1).cast("double") / (F.col("_cv") + F.lit(n_voc)).cast("double"))
    # pairs meet their first word's count where they lie; only those of rare first words are shuffled
    scored = join_by_key(pairs, after, ["prev"], "_after", size[0], 4 * size[2] + 64 * size[1], reread=True,
                         limit=head_limit((after, size[0]), ("prev",), "_after"))
    scored = materialised(scored.select("prev", "_key", "_cvw", surp.alias("surp")), "bigram-scores")          # hot and other pairs both read it
    st = pairs.agg(F.coalesce(F.sum("_cvw"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.length("prev") + F.length("_key")), F.lit(0))).first()
    if 4 * st[2] + 64 * st[1] <= VOCABULARY_BYTES:
        got = toks.join(F.broadcast(scored), ["prev", "_key"], "left")
    else:
        limit = head_limit((pairs, st[0]), ("prev", "_key"), "_cvw")
        head = F.broadcast(scored.where(F.col("_cvw") > limit))
        rest = toks.join(head.select("prev", "_key"), ["prev", "_key"], "left_anti")
        rest = looked_up(rest, scored.where(F.col("_cvw") <= limit), ["prev", "_key"], "surp", [id_col, "tok_pos"])
        got = toks.join(head, ["prev", "_key"]).select(*rest.columns).unionByName(rest)
    return got.select(id_col, "tok_pos", "word", "prev", "surp")


def token_surprisal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return array_token_table(docs.select(id_col, T.tokens(text_col).alias("tokens")), id_col)


def doc_surprisal_sums(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       out_col: str = "surprisal") -> DataFrame:
    """G1 for the corpus-count surprisal without the token table: tokens meet their
    counts (head words in place), and the sums are aggregated in every task before the
    shuffle.  Documents without a token have the sum 0."""
    toks = exploded(docs, id_col, T.tokens(text_col))
    counted = corpus_counts(toks)
    denom = float(counted[1] + counted[2])
    per = join_counts(toks, counted).groupBy(id_col).agg(
        F.sum(-F.log2((F.col("_c") + 1).cast("double") / F.lit(denom))).alias(out_col))
    return docs.select(id_col).join(per, id_col, "left").fillna(0.0, [out_col])


def doc_sums(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_tokens and the sums of wlen, sentpos and surp of its token table, in one pass: the
    sums that need only the row ride along with its tokens to their counts.  Zeros without a token."""
    toks = T.tokens(text_col)
    wide = docs.select(id_col, toks.alias("_toks"))
    held = ("n_tokens", "wlen", "sentpos")
    # the sums are columns before the explode, or they would be taken again for every token
    wide = wide.select(id_col, "_toks", *[c.alias(n) for n, c in zip(held, _row_sums(F.col("_toks")))])
    rows = wide.select(id_col, F.explode_outer("_toks").alias("_w"), *held)
    rows = rows.where("_w is not null").select(id_col, *held, F.lower("_w").alias("_key"))
    counted = corpus_counts(exploded(docs, id_col, toks))
    denom = float(counted[1] + counted[2])
    per = join_counts(rows, counted).groupBy(id_col).agg(
        *[F.max(c).alias(c) for c in held], F.sum(-F.log2((F.col("_c") + 1).cast("double") / F.lit(denom))).alias("surp"))
    return docs.select(id_col).join(per, id_col, "left").fillna(0, list(held)).fillna(0.0, ["surp"])


def _row_sums(toks: Column) -> tuple[Column, Column, Column]:
    """Number of a token array's tokens, their lengths' sum and their sentence positions' sum.
    A sentence of L tokens contributes 1 + ... + L."""
    zero = F.lit(0).cast("long")
    sentpos = F.aggregate(sentence_lengths(toks), zero, lambda acc, n: acc + F.floor(n * (n + 1) / 2).cast("long"))
    wlen = F.aggregate(F.transform(toks, lambda w: F.length(w).cast("long")), zero, lambda acc, n: acc + n)
    return F.size(toks).cast("long"), wlen, sentpos


def doc_token_sums(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: token count and the sums of wlen and sentpos of its token
    table, as row expressions on the token array (no explode, no window)."""
    n, wlen, sentpos = _row_sums(T.tokens(text_col))
    return docs.select(id_col, n.alias("n_tokens"), wlen.alias("wlen"), sentpos.alias("sentpos"))


def surprisal_per_doc(token_tbl: DataFrame, id_col: str, surp_col: str = "surp",
                      out_col: str = "surprisal") -> DataFrame:
    """G1: sum of token surprisal per document (partial aggregation per task)."""
    return token_tbl.groupBy(id_col).agg(F.sum(surp_col).alias(out_col))
