"""Registered queries: classification / regression metrics and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics as M
from . import fixtures as X
from .oracle_views import with_views
from .registry import _t, query, r6

_CONF = """SELECT CAST(count(*) AS BIGINT) AS n,
       CAST(count(*) FILTER (WHERE label = 1 AND pred = 1) AS DOUBLE) AS tp,
       CAST(count(*) FILTER (WHERE label = 0 AND pred = 1) AS DOUBLE) AS fp,
       CAST(count(*) FILTER (WHERE label = 1 AND pred = 0) AS DOUBLE) AS fn,
       CAST(count(*) FILTER (WHERE label = pred) AS DOUBLE) AS correct FROM binary_preds"""
_OTHER = _CONF.replace("FROM binary_preds", "FROM (SELECT label, 1 - pred AS pred FROM binary_preds)")
_F1 = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END"


@query("metric_accuracy", with_views(
    "SELECT round(CAST(count(*) FILTER (WHERE label = pred) AS DOUBLE) / count(*), 6) AS acc FROM binary_preds",
    "binary_preds"))
def q_accuracy(spark, sf):
    return M.accuracy(X.binary_preds(_t(spark, sf))).select(r6("acc").alias("acc"))


@query("metric_f1", with_views(f"""
SELECT round(correct / n, 6) AS acc, round({_F1}, 6) AS f1, round((correct / n + {_F1}) / 2, 6) AS acc_and_f1
FROM ({_CONF})""", "binary_preds"))
def q_f1(spark, sf):
    r = M.acc_and_f1(X.binary_preds(_t(spark, sf)))
    return r.select(*[r6(c).alias(c) for c in ("acc", "f1", "acc_and_f1")])


def _mcc_sql(src: str, label: str, pred: str) -> str:
    return f"""(WITH cm AS (SELECT {label} AS l, {pred} AS p, count(*) AS m FROM {src} GROUP BY 1, 2),
  tk AS (SELECT l AS k, sum(m) AS t_k FROM cm GROUP BY 1),
  pk AS (SELECT p AS k, sum(m) AS p_k FROM cm GROUP BY 1),
  tp AS (SELECT coalesce(t_k, 0) AS t_k, coalesce(p_k, 0) AS p_k FROM tk FULL OUTER JOIN pk ON tk.k = pk.k),
  a AS (SELECT CAST(sum(t_k * p_k) AS DOUBLE) AS tps, CAST(sum(t_k * t_k) AS DOUBLE) AS tt,
               CAST(sum(p_k * p_k) AS DOUBLE) AS pp FROM tp),
  c AS (SELECT CAST(sum(CASE WHEN l = p THEN m ELSE 0 END) AS DOUBLE) AS c, CAST(sum(m) AS DOUBLE) AS s FROM cm)
 SELECT CASE WHEN (s * s - pp) * (s * s - tt) > 0
             THEN (c * s - tps) / sqrt((s * s - pp) * (s * s - tt)) ELSE 0.0 END AS mcc FROM a, c)"""


@query("metric_mcc", with_views(f"""
SELECT 'binary' AS dataset, round(mcc, 6) AS mcc FROM {_mcc_sql('binary_preds', 'label', 'pred')}
UNION ALL
SELECT 'multiclass', round(mcc, 6) FROM {_mcc_sql(
    "(SELECT label, CAST(list_position(scores, list_max(scores)) - 1 AS BIGINT) AS pred FROM class_scores)",
    'label', 'pred')}""", "binary_preds", "class_scores"))
def q_mcc(spark, sf):
    t = _t(spark, sf)
    b = M.mcc(X.binary_preds(t)).select(F.lit("binary").alias("dataset"), r6("mcc").alias("mcc"))
    cs = X.class_scores(t).select("label", T.argmax("scores").alias("pred"))
    m = M.mcc(cs).select(F.lit("multiclass").alias("dataset"), r6("mcc").alias("mcc"))
    return b.unionByName(m)


_RANKS = """SELECT y, yhat,
   rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry,
   rank() OVER (ORDER BY yhat) + (count(*) OVER (PARTITION BY yhat) - 1) / 2.0 AS rp
 FROM reg_preds"""


@query("metric_pearson", with_views("""
SELECT round(corr(y, yhat), 6) AS pearson, round(avg((yhat - y) * (yhat - y)), 6) AS mse,
       round(sqrt(avg((yhat - y) * (yhat - y))), 6) AS rmse FROM reg_preds""", "reg_preds"))
def q_pearson(spark, sf):
    r = M.pearson(X.reg_preds(_t(spark, sf)))
    return r.select(r6("pearson").alias("pearson"), r6("mse").alias("mse"), r6("rmse").alias("rmse"))


@query("metric_spearman", with_views(f"""
SELECT round(corr(ry, rp), 6) AS spearman, round((corr(y, yhat) + corr(ry, rp)) / 2, 6) AS corr
FROM ({_RANKS})""", "reg_preds"))
def q_spearman(spark, sf):
    r = M.pearson_and_spearman(X.reg_preds(_t(spark, sf)))
    return r.select(r6("spearman").alias("spearman"), r6("corr").alias("corr"))


def _task_metric_rows(spark, sf):
    """Metrics of all ten tasks on the fixture predictions, stacked."""
    t = _t(spark, sf)
    parts = []
    three = X.class_scores(t).select((F.col("label") % 3).alias("label"), (T.argmax("scores") % 3).alias("pred"))
    other = X.binary_preds(t).withColumn("pred", 1 - F.col("pred"))
    for task, df, cols in (("cola", X.binary_preds(t), ["mcc"]),
                           ("mrpc", X.binary_preds(t), ["acc", "f1", "acc_and_f1"]),
                           ("sst-2", X.binary_preds(t), ["acc"]),
                           ("qqp", other, ["acc", "f1", "acc_and_f1"]),
                           ("mnli", three, ["acc"]), ("mnli-mm", three, ["acc"]),
                           ("qnli", other, ["acc"]), ("rte", X.binary_preds(t), ["acc"]), ("wnli", other, ["acc"]),
                           ("sts-b", X.reg_preds(t).withColumnRenamed("y", "label")
                                                 .withColumnRenamed("yhat", "pred"),
                            ["pearson", "spearman", "corr", "mse"])):
        wide = M.compute_metrics(task, df)
        parts.append(M.stack_metrics(wide, cols).withColumn("task", F.lit(task)))
    return reduce(lambda a, b: a.unionByName(b), parts)


_TASK_SQL = f"""
SELECT 'cola' AS task, 'mcc' AS metric, mcc AS value FROM {_mcc_sql('binary_preds', 'label', 'pred')}
UNION ALL SELECT 'mrpc', 'acc', correct / n FROM ({_CONF})
UNION ALL SELECT 'mrpc', 'f1', {_F1} FROM ({_CONF})
UNION ALL SELECT 'mrpc', 'acc_and_f1', (correct / n + {_F1}) / 2 FROM ({_CONF})
UNION ALL SELECT 'sst-2', 'acc', correct / n FROM ({_CONF})
UNION ALL SELECT 'qqp', 'acc', correct / n FROM ({_OTHER})
UNION ALL SELECT 'qqp', 'f1', {_F1} FROM ({_OTHER})
UNION ALL SELECT 'qqp', 'acc_and_f1', (correct / n + {_F1}) / 2 FROM ({_OTHER})
UNION ALL SELECT 'qnli', 'acc', correct / n FROM ({_OTHER})
UNION ALL SELECT 'rte', 'acc', correct / n FROM ({_CONF})
UNION ALL SELECT 'wnli', 'acc', correct / n FROM ({_OTHER})
UNION ALL SELECT m, 'acc', avg(CAST(label % 3 = (list_position(scores, list_max(scores)) - 1) % 3 AS DOUBLE))
  FROM class_scores, (SELECT unnest(['mnli', 'mnli-mm']) AS m) GROUP BY m
UNION ALL SELECT 'sts-b', 'pearson', corr(y, yhat) FROM reg_preds
UNION ALL SELECT 'sts-b', 'spearman', corr(ry, rp) FROM ({_RANKS})
UNION ALL SELECT 'sts-b', 'corr', (corr(y, yhat) + corr(ry, rp)) / 2 FROM ({_RANKS})
UNION ALL SELECT 'sts-b', 'mse', avg((yhat - y) * (yhat - y)) FROM reg_preds"""


@query("metrics_by_task", with_views(
    f"SELECT task, metric, round(value, 6) AS value FROM ({_TASK_SQL})", "binary_preds", "reg_preds", "class_scores"))
def q_metrics_by_task(spark, sf):
    return _task_metric_rows(spark, sf).select("task", "metric", r6("value").alias("value"))


@query("metrics_report", with_views(
    f"SELECT metric, metric || ' = ' || printf('%.6f', value) AS line FROM ({_TASK_SQL}) WHERE task = 'sts-b'",
    "binary_preds", "reg_preds", "class_scores"))
def q_metrics_report(spark, sf):
    """K5: the sts-b metrics written as sorted ``key = value`` lines and read back."""
    from ..session import scratch_path
    from ..sources import write_metrics_report
    rows = _task_metric_rows(spark, sf).where(F.col("task") == "sts-b")
    path = scratch_path(spark, "eval-results")
    write_metrics_report(rows, path)
    back = spark.read.text(path)
    return back.select(F.split("value", " = ").getItem(0).alias("metric"), F.col("value").alias("line"))


@query("argmax_class", with_views("""
SELECT vec_id, CAST(list_position(scores, list_max(scores)) - 1 AS BIGINT) AS pred, label FROM class_scores""",
                                  "class_scores"))
def q_argmax(spark, sf):
    cs = X.class_scores(_t(spark, sf))
    return cs.select("vec_id", T.argmax("scores").alias("pred"), "label")


_CE = """SELECT vec_id, label, CAST(list_position(scores, list_max(scores)) - 1 AS BIGINT) AS pred,
   ln(list_sum(list_transform(s, lambda x: exp(x - list_max(s))))) + list_max(s) - s[label + 1] AS loss
 FROM (SELECT vec_id, label, scores, list_transform(scores, lambda x: CAST(x AS DOUBLE)) AS s FROM class_scores)"""


@query("batch_mean_loss", with_views(f"""
SELECT round(avg(bl), 6) AS eval_loss, CAST(count(*) AS BIGINT) AS n_batches FROM (
  SELECT batch, avg(loss) AS bl
  FROM (SELECT (row_number() OVER (ORDER BY vec_id) - 1) // 8 AS batch, loss FROM ({_CE})) GROUP BY 1)""",
                                     "class_scores"))
def q_batch_mean_loss(spark, sf):
    cs = X.class_scores(_t(spark, sf)).withColumn("loss", M.cross_entropy("scores", "label"))
    r = M.batch_mean_loss(cs, "vec_id", "loss", 8)
    return r.select(r6("eval_loss").alias("eval_loss"), "n_batches")


@query("evaluate_scores", with_views(f"""
SELECT round(avg(CAST(pred = label AS DOUBLE)), 6) AS acc,
       (SELECT round(avg(bl), 6) FROM (SELECT b, avg(loss) AS bl FROM (
          SELECT (row_number() OVER (ORDER BY vec_id) - 1) // 8 AS b, loss FROM ({_CE})) GROUP BY 1)) AS eval_loss
FROM ({_CE})""", "class_scores"))
def q_evaluate_scores(spark, sf):
    """Score -> argmax -> task metric + mean batch loss, one result row."""
    cs = X.class_scores(_t(spark, sf))
    scored = cs.select("vec_id", "label", T.argmax("scores").alias("pred"),
                       M.cross_entropy("scores", "label").alias("loss")).persist()
    acc = M.accuracy(scored).select(r6("acc").alias("acc"), F.lit(0).alias("_k"))
    loss = M.batch_mean_loss(scored, "vec_id", "loss", 8).select(r6("eval_loss").alias("eval_loss"),
                                                                   F.lit(0).alias("_k"))
    return acc.join(loss, "_k").drop("_k")
