"""Registered queries: pooling, embedding distinct texts, stacking, checks, splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import embed as EM
from ..operators import prep as P
from ..operators.split import train_dev_test_split
from . import fixtures as X
from .oracle_views import TOK, with_views
from .registry import _ALIGN_CTE, _TOKENS_CTE, _aligned, _t, query, r6


def _pool_sql(agg: str) -> str:
    return with_views(f"""
SELECT doc, CAST(dim - 1 AS BIGINT) AS dim, round({agg}(CAST(v AS DOUBLE)), 6) AS value
FROM (SELECT doc, generate_subscripts(vec, 1) AS dim, unnest(vec) AS v FROM token_vectors) GROUP BY 1, 2""",
                      "token_vectors")


def _pool(spark, sf, how):
    p = EM.pool_vectors(X.token_vectors(_t(spark, sf)), "doc", "vec", how)
    return EM.explode_vector(p, "doc", "pooled").select("doc", "dim", r6("value").alias("value"))


@query("pool_mean", _pool_sql("avg"))
def q_pool_mean(spark, sf):
    return _pool(spark, sf, "mean")


@query("pool_min", _pool_sql("min"))
def q_pool_min(spark, sf):
    return _pool(spark, sf, "min")


@query("pool_max", _pool_sql("max"))
def q_pool_max(spark, sf):
    return _pool(spark, sf, "max")


@query("embed_distinct_join", with_views("""
SELECT survey_num, md5(text) AS text_md5, CAST(64 AS BIGINT) AS emb_dim,
       CAST(count(*) OVER (PARTITION BY md5(text)) AS BIGINT) AS copies
FROM texts""", "texts"))
def q_embed_distinct(spark, sf):
    """Each distinct text embedded once (hashing embedder), joined back to
    every article key holding it; ``copies`` counts keys sharing the vector."""
    x = X.texts(_t(spark, sf))
    j = EM.embed_distinct(x, "text", lambda d: EM.embed_hashing(d, "text", 64))
    copies = j.groupBy("text_md5").agg(F.count(F.lit(1)).alias("copies"))
    return (j.join(copies, "text_md5")
             .select("survey_num", "text_md5", F.size("embedding").cast("long").alias("emb_dim"), "copies"))


@query("stack_features", with_views("""
SELECT r.response_id, CAST(coalesce(num_words, 0) AS DOUBLE) AS f0, CAST(hour_of_day AS DOUBLE) AS f1,
       """ + ", ".join(f"CASE WHEN length(x.text) > 0 THEN CAST(length(x.text) - length(replace(x.text, '{c}', '')) AS DOUBLE) "
                       f"/ length(x.text) ELSE 0.0 END AS f{i + 2}" for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")) + """
FROM responses r LEFT JOIN texts x ON x.survey_num = r.survey_num""", "responses", "texts"))
def q_stack_features(spark, sf):
    """Numeric response features and the text embedding concatenated by
    key (zeros where the response has no text)."""
    t = _t(spark, sf)
    r = X.responses(t).withColumn("x_words", F.coalesce(F.col("num_words"), F.lit(0)).cast("double"))
    emb = EM.embed_distinct(X.texts(t), "text", lambda d: EM.embed_batches(d, EM.letter_profile_encoder, "text"))
    s = P.stack_features(r, "survey_num", ["x_words", "hour_of_day"], EM.with_zero_fill(emb, "embedding", 26),
                         "survey_num", "embedding")
    s = s.withColumn("features", F.coalesce(F.col("features"),
                                            F.concat(F.array(F.col("x_words"), F.col("hour_of_day").cast("double")),
                                                     F.array_repeat(F.lit(0.0), 26))))
    return s.select("response_id", *[F.col("features")[i].alias(f"f{i}") for i in range(28)])


@query("embed_hashing")
def q_embed_hashing(spark, sf):
    d = _t(spark, sf).documents
    return EM.embed_hashing(d.select("doc_id", "text"), "text", 64).select("doc_id", "embedding")


@query("embed_word2vec")
def q_embed_word2vec(spark, sf):
    d = _t(spark, sf).documents.select("doc_id", "text")
    model = EM.fit_word2vec(d, "text", width=32)
    return EM.embed_word2vec(d, model, "text").select("doc_id", "embedding")


@query("embed_word2vec_folds", with_views(f"""
WITH f AS (SELECT doc_id, CAST(ntile(5) OVER (ORDER BY doc_id) - 1 AS BIGINT) AS fold,
                  list_transform(regexp_extract_all(text, '{TOK}'), lambda w: lower(w)) AS toks FROM documents),
t AS (SELECT doc_id, fold, unnest(toks) AS w FROM f),
k AS (SELECT w, min(fold) AS lo, max(fold) AS hi FROM t GROUP BY w)
SELECT f.doc_id, f.fold, CAST(len(f.toks) AS BIGINT) AS n_tokens, CAST(count(k.w) FILTER (lo <> f.fold OR hi <> f.fold) AS BIGINT) AS n_known,
       count(k.w) FILTER (lo <> f.fold OR hi <> f.fold) > 0 AS has_vector
FROM f LEFT JOIN t ON t.doc_id = f.doc_id LEFT JOIN k ON k.w = t.w GROUP BY f.doc_id, f.fold, len(f.toks)"""))
def q_embed_word2vec_folds(spark, sf):
    """D2 fitted inside the training folds: every article embedded by word vectors learned without its fold; how many
    of its tokens those know, and whether it has a vector at all."""
    from ..functions import text as T
    from ..operators.indexing import assign_folds
    d = assign_folds(_t(spark, sf).documents.select("doc_id", "text"), "doc_id", 5)
    models = EM.fold_models(d, "fold", lambda rows: EM.fit_word2vec(rows, "text", width=32))
    vecs = EM.embed_out_of_fold(d, "fold", models, lambda rows, m: EM.embed_word2vec(rows, m, "text"))
    words = reduce(lambda a, b: a.unionByName(b), [m.getVectors().select(F.lit(f).cast("long").alias("fold"), F.col("word").alias("w")) for f, m in models.items()])
    toks = d.select("doc_id", "fold", F.explode(F.transform(T.tokens("text"), lambda w: F.lower(w))).alias("w"))
    known = toks.groupBy("doc_id", "fold", "w").count().join(words, ["fold", "w"]).groupBy("doc_id").agg(F.sum("count").alias("n_known"))
    out = vecs.select("doc_id", "fold", F.size(T.tokens("text")).cast("long").alias("n_tokens"), F.exists("embedding", lambda x: x != 0).alias("has_vector"))
    return out.join(known, "doc_id", "left").withColumn("n_known", F.coalesce("n_known", F.lit(0)))


@query("data_checks", with_views(f"""
SELECT 'responses_without_text' AS rule, CAST(count(*) FILTER (WHERE num_words IS NULL) AS BIGINT) AS violations
  FROM responses
UNION ALL SELECT 'texts_without_responses', CAST(count(*) AS BIGINT) FROM texts x
  WHERE NOT EXISTS (SELECT 1 FROM responses r WHERE r.survey_num = x.survey_num)
UNION ALL SELECT 'embedding_width', CAST(count(*) FILTER (WHERE len(embedding) <> 64) AS BIGINT) FROM embeddings
UNION ALL SELECT 'empty_text', CAST(count(*) FILTER (WHERE len(regexp_extract_all(text, '{TOK}')) = 0) AS BIGINT)
  FROM documents
UNION ALL SELECT 'word_without_rt', CAST(count(*) AS BIGINT) FROM stories s
  WHERE NOT EXISTS (SELECT 1 FROM word_rts r WHERE r.word = s.word AND r.zone = s.zone AND r.item = s.item)
UNION ALL SELECT 'unknown_label', CAST(count(*) FILTER (WHERE label NOT IN (0, 1)) AS BIGINT) FROM binary_preds
UNION ALL SELECT 'alignment_mismatch',
  CAST(count(*) FILTER (WHERE NOT (pieces = word OR contains(pieces, '<unk>'))) AS BIGINT) FROM al""",
                                 "responses", "texts", "stories", "word_rts", "lm_tokens", "binary_preds",
                                 extra=_ALIGN_CTE))
def q_data_checks(spark, sf):
    """Violation counts per rule (each one aggregate; anti joins for the
    unmatched-key rules)."""
    from ..functions import text as T
    aligned, A, t = _aligned(spark, sf)
    r, x = X.responses(t), X.texts(t)
    checks = [
        P.violations(r, "responses_without_text", F.col("num_words").isNotNull()),
        P.violations(x.join(r.select("survey_num").distinct(), "survey_num", "left_anti"),
                     "texts_without_responses", F.lit(False)),
        P.violations(t.embeddings, "embedding_width", F.size("embedding") == 64),
        P.violations(t.documents, "empty_text", F.size(T.tokens("text")) > 0),
        P.violations(A.join_word_rt(X.stories(t), X.word_rts(t).withColumn("there", F.lit(1.0)), rt="there"),
                     "word_without_rt", F.col("rt").isNotNull()),
        P.violations(X.binary_preds(t), "unknown_label", F.col("label").isin(0, 1)),
        P.violations(aligned,
                     "alignment_mismatch", F.col("matched") == 1),
    ]
    return reduce(lambda a, b: a.unionByName(b), checks)


def _split_sql(seed: int) -> str:
    return f"""SELECT {seed} AS seed, survey_num, CASE WHEN r <= n_test THEN 'test' WHEN r <= n_hold THEN 'dev' ELSE 'train' END AS split
FROM (SELECT survey_num, row_number() OVER (ORDER BY md5('{seed}|' || CAST(survey_num AS VARCHAR)), survey_num) AS r,
             CAST(ceil(0.3 * count(*) OVER ()) AS BIGINT) AS n_hold, CAST(ceil(ceil(0.3 * count(*) OVER ()) / 2) AS BIGINT) AS n_test FROM texts)"""


@query("seeded_splits", with_views(_split_sql(1) + " UNION ALL " + _split_sql(2), "texts"))
def q_seeded_splits(spark, sf):
    """two seeds give two splits, each the same on every run."""
    x = X.texts(_t(spark, sf)).select("survey_num")
    return reduce(lambda a, b: a.unionByName(b), [
        train_dev_test_split(x, "survey_num", 0.3, seed).select(F.lit(seed).alias("seed"), "survey_num", "split") for seed in (1, 2)])


@query("train_dev_test_split", """
SELECT survey_num, CASE WHEN r < CAST(ceil(0.3 * n) AS BIGINT) - CAST(floor(CAST(ceil(0.3 * n) AS BIGINT) / 2) AS BIGINT)
                        THEN 'test'
                        WHEN r < CAST(ceil(0.3 * n) AS BIGINT) THEN 'dev' ELSE 'train' END AS split
FROM (SELECT doc_id AS survey_num, row_number() OVER (ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS r,
             count(*) OVER () AS n FROM documents)""")
def q_split(spark, sf):
    x = X.texts(_t(spark, sf)).select("survey_num")
    return train_dev_test_split(x, "survey_num", 0.3, 42)


@query("sink_json_map", with_views(
    "SELECT doc_id, round(sum(surp), 6) AS surprisal FROM tt GROUP BY 1",
    extra=_TOKENS_CTE))
def q_sink_json_map(spark, sf):
    """K4: the written JSON lines parsed line by line (one object per line)."""
    from ..operators import surprisal as S
    from ..session import scratch_path
    from ..sources import write_json_map
    path = scratch_path(spark, "json-sink")
    write_json_map(S.surprisal_per_doc(S.token_surprisal(_t(spark, sf).documents), "doc_id"),
                   "doc_id", "surprisal", path)
    m = F.from_json(F.col("value"), "map<string,double>")
    back = spark.read.text(path).select(F.explode(m).alias("k", "v"))
    return back.select(F.col("k").cast("long").alias("doc_id"), r6("v").alias("surprisal"))


@query("stream_surprisal", with_views(
    "SELECT doc_id, round(sum(surp), 6) AS surprisal, CAST(count(*) AS BIGINT) AS n_tokens FROM tt GROUP BY 1",
    extra=_TOKENS_CTE))
def q_stream_surprisal(spark, sf):
    """G1 as a streaming job: token tables land in bucket folders, a file-source
    stream sums them per document and micro-batch, totals are read back."""
    from ..operators import surprisal as S
    from ..session import scratch_path
    from ..sources import write_token_buckets
    from ..streaming import start_surprisal_stream, stream_totals
    src, out, ck = (scratch_path(spark, n) for n in ("stream-in", "stream-out", "stream-ck"))
    write_token_buckets(S.token_surprisal(_t(spark, sf).documents), src, "doc_id")
    q = start_surprisal_stream(spark, src, out, ck, glob="*.csv.gz", key_col="doc_id")
    q.awaitTermination()
    tot = stream_totals(spark, out)
    return tot.select(F.col("doc_key").cast("long").alias("doc_id"), r6("surprisal").alias("surprisal"),
                      F.col("n_tokens").cast("long").alias("n_tokens"))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


@query("embed_user_model", with_views(
    "SELECT survey_num, text_md5, dim, value FROM (" + " UNION ALL ".join(
        f"SELECT survey_num, md5(text) AS text_md5, CAST({i} AS BIGINT) AS dim, "
        f"CASE WHEN length(text) > 0 THEN CAST(length(text) - length(replace(text, '{c}', '')) AS DOUBLE) "
        f"/ length(text) ELSE 0.0 END AS value FROM texts"
        for i, c in enumerate(_LETTERS)) + ")", "texts"))
def q_embed_user_model(spark, sf):
    """D2 + J5: a user encoder run in Arrow batches (built once per task) over
    the distinct texts only, joined back to every article key.  Values are a
    single IEEE division in both engines, so they are compared unrounded
    (rounding rules for exact decimal ties differ between engines)."""
    x = X.texts(_t(spark, sf))
    j = EM.embed_distinct(x, "text", lambda d: EM.embed_batches(d, EM.letter_profile_encoder, "text"))
    return EM.explode_vector(j, "survey_num", "embedding").join(
        j.select("survey_num", "text_md5"), "survey_num").select("survey_num", "text_md5", "dim", "value")
