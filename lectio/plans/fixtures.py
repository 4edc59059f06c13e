"""Derived input views built from the given tables by fixed rules.

The reference's own inputs (survey responses, story words, per-word reading
times, task TSVs) are not available; these views derive inputs of the same
shape from the given tables, identically here (Spark) and in the SQL oracle
(``oracle_views.py``).  They always cover whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


class Tables:
    """Lazy table access for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            return spread(df) if name in TEXT_TABLES else df
        raise AttributeError(name)


TEXT_TABLES = {"documents", "pages", "conversations"}


def spread(df: DataFrame) -> DataFrame:
    """Text tables are CPU-bound (regex tokenising): when a scan yields fewer
    splits than the cluster has cores (a few large row groups), spread the
    rows round-robin so every core works.  A large table already has more
    splits than cores and is left untouched (no extra shuffle)."""
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001  (e.g. a Connect session: leave the scan as it is)
        return df
    return df.repartition(cores) if splits < cores else df


def texts(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("survey_num"), "text")


def doc_word_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.whitespace_word_count("text").alias("num_words"))


def responses(t: Tables) -> DataFrame:
    """Survey-like responses: ``survey_num = 3 + event_id % (n + 4)`` so both
    sides of the responses/texts outer join have unmatched keys."""
    n = t.documents.select(F.count(F.lit(1))).scalar()
    ev = t.events.select(
        F.col("event_id").alias("response_id"),
        (F.lit(3) + F.col("event_id") % (n + F.lit(4))).alias("survey_num"),
        F.col("user_id").alias("person_id"),
        F.hour("ts").cast("long").alias("hour_of_day"),
        F.col("event_type").alias("device"),
        "value")
    wc = doc_word_counts(t).withColumnRenamed("doc_id", "survey_num")
    return (ev.join(wc, "survey_num", "left")
              .withColumn("reading_time",
                          F.coalesce(F.col("num_words"), F.lit(100)).cast("double") / 4.0 + F.col("value"))
              .select("response_id", "survey_num", "person_id", "hour_of_day", "device",
                      "value", "num_words", "reading_time"))


def stories(t: Tables) -> DataFrame:
    """Story words (item, zone, word): every document, whitespace words,
    ``zone`` numbered from 1."""
    return (t.documents
             .select(F.col("doc_id").alias("item"),
                     F.posexplode(T.whitespace_words("text")).alias("pos", "word"))
             .select("item", (F.col("pos") + 1).cast("long").alias("zone"), "word"))


def word_rts(t: Tables) -> DataFrame:
    s = stories(t)
    subj = F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))
    return s.select("word", "zone", "item", subj.alias("subject"),
                    (F.lit(250.0) + F.lit(10.0) * F.length("word") + F.col("zone") % 7)
                    .cast("double").alias("meanItemRT"))


def lm_token_arrays(t: Tables) -> DataFrame:
    """(item, words, tokens): a story's words, and the tokens of its words, in order, in one row."""
    toks = F.flatten(F.transform(T.whitespace_words("text"), lambda w: T.tokens(w)))
    return t.documents.select(F.col("doc_id").alias("item"), T.whitespace_words("text").alias("words"), toks.alias("tokens"))


def drift_token_arrays(t: Tables) -> DataFrame:
    """``lm_token_arrays`` of another tokenizer: every third word is one token whatever its
    pieces, every eleventh has an unknown first piece, and in every seventh story word 25 is
    followed by a token of no word."""
    def pieces(w, i):
        own = T.tokens(w)
        unk = F.concat(F.array(F.lit("<unk>")), F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))))
        said = F.when(i % 3 == 2, F.array(w)).when(i % 11 == 10, unk).otherwise(own)
        return F.when((i == 24) & (F.col("doc_id") % 7 == 3), F.concat(said, F.array(F.lit("zzz")))).otherwise(said)
    toks = F.flatten(F.transform(T.whitespace_words("text"), pieces))
    return t.documents.select(F.col("doc_id").alias("item"), T.whitespace_words("text").alias("words"), toks.alias("tokens"))


def pairs(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t.conversations.withColumn("text_b", F.lead("text").over(w))
    return c.select("conv_id", "turn", F.col("text").alias("text_a"), "text_b")


def binary_preds(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "n_chars")
    return (t.labels.join(d, "doc_id")
             .select("doc_id", F.col("quality").cast("long").alias("label"),
                     (F.col("n_chars") > 500).cast("long").alias("pred")))


def reg_preds(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.col("n_chars").cast("double").alias("y"),
                              (F.lit(5.0) * T.whitespace_word_count("text")).alias("yhat"))


def class_scores(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.col("embedding").alias("scores"),
                               F.col("label").cast("long").alias("label"))


def token_vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("label").cast("long").alias("doc"),
                               F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"))


def seed_runs(t: Tables) -> DataFrame:
    e = t.events
    return (e.groupBy(F.col("event_type").alias("name"), (F.col("event_id") % 5).alias("seed"))
             .agg(F.avg(F.abs(F.col("value") - 40)).alias("mae"),
                  F.sqrt(F.avg(F.pow(F.col("value") - 40, 2))).alias("rmse")))


# ---- task TSV lines (shared SQL expressions: evaluated by Spark and the oracle alike)
_CLEAN = "translate({x}, chr(9) || chr(10) || chr(13), '   ')"
_A = _CLEAN.format(x="text_a")
_B = _CLEAN.format(x="coalesce(text_b, '')")
_TX = _CLEAN.format(x="text")
_CID = "CAST(conv_id AS STRING)"
_TURN = "CAST(turn AS STRING)"
_L2 = "CAST((conv_id + turn) % 2 AS STRING)"
_LB2 = "CAST(item_id % 2 AS STRING)"
_LNLI = "CASE (conv_id + turn) % 3 WHEN 0 THEN 'contradiction' WHEN 1 THEN 'entailment' ELSE 'neutral' END"
_LQNLI = "CASE (conv_id + turn) % 2 WHEN 0 THEN 'entailment' ELSE 'not_entailment' END"

# task -> (source view, order keys, header?, field expressions)
TASK_LINES = {
    "mrpc": ("pairs", ["conv_id", "turn"], True, [_L2, _CID, _TURN, _A, _B]),
    "mnli": ("pairs", ["conv_id", "turn"], True,
             [_CID, _TURN, "'g'", "'p'", "'x'", "'x'", "'x'", "'x'", _A, _B, _LNLI]),
    "mnli-mm": ("pairs", ["conv_id", "turn"], True,
                [_CID, _TURN, "'g'", "'p'", "'x'", "'x'", "'x'", "'x'", _A, _B, _LNLI]),
    "cola": ("benchmark", ["item_id"], False, ["'b' || CAST(item_id AS STRING)", _LB2, "''", _TX]),
    "sst-2": ("benchmark", ["item_id"], True, [_TX, _LB2]),
    "sts-b": ("benchmark", ["item_id"], True, [_TX, "printf('%.2f', length(text) / CAST(100 AS DOUBLE))"]),
    "qqp": ("pairs", ["conv_id", "turn"], True, [_CID, _TURN, "CAST(turn + 1 AS STRING)", _A, _B, _L2]),
    "qnli": ("pairs", ["conv_id", "turn"], True, [_CID, _A, _B, _LQNLI]),
    "rte": ("pairs", ["conv_id", "turn"], True, [_CID, _A, _B, _LQNLI]),
    "wnli": ("pairs", ["conv_id", "turn"], True, [_CID, _A, _B, _L2]),
}


def line_expr(fields: list[str], line_no: str = "line_no") -> str:
    """Tab-joined fields; every 7th line (line_no % 7 = 6) loses its last field."""
    full = "concat_ws(chr(9), {})".format(", ".join(fields))
    short = "concat_ws(chr(9), {})".format(", ".join(fields[:-1]))
    return f"CASE WHEN {line_no} % 7 = 6 THEN {short} ELSE {full} END"


def header_line(fields: list[str]) -> str:
    return "\t".join(f"f{i}" for i in range(len(fields)))


def task_lines(t: Tables, task: str) -> DataFrame:
    """(task, line_no, line) of one task file, header first where the layout has one."""
    from ..operators.indexing import with_row_index
    source, keys, header, fields = TASK_LINES[task]
    src = pairs(t) if source == "pairs" else t.benchmark
    idx = with_row_index(src, keys, "_r")
    data = idx.withColumn("line_no", F.col("_r") + (1 if header else 0))
    out = data.select(F.lit(task).alias("task"), "line_no", F.expr(line_expr(fields)).alias("line"))
    if header:
        spark = t.spark
        h = spark.createDataFrame([(task, 0, header_line(fields))], "task string, line_no long, line string")
        out = h.unionByName(out)
    return out


def all_task_lines(t: Tables) -> DataFrame:
    from functools import reduce
    return reduce(lambda a, b: a.unionByName(b), [task_lines(t, k) for k in TASK_LINES])
