"""Metrics and reports.

All are plain aggregates: confusion counts with ``count_if``, correlations
with ``corr``, and Spearman via distributed average ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .indexing import average_rank, with_row_index


def regression_scores(df: DataFrame, group_cols=(), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """RMSE, MAE, MSE and R^2 per group (R^2 from one pass:
    SST = sum y^2 - n * mean(y)^2)."""
    err = F.col(yhat) - F.col(y)
    a = df.groupBy(*group_cols).agg(
        F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"),
        F.sum(err * err).alias("_sse"), F.var_pop(y).alias("_vy"), F.count(F.lit(1)).alias("_n"))
    return a.select(*group_cols, F.sqrt("mse").alias("rmse"), "mae", "mse",
                    F.when(F.col("_vy") > 0, 1 - F.col("_sse") / (F.col("_vy") * F.col("_n")))
                    .alias("r2"))


def fold_scores(preds: DataFrame, group_cols=("group", "name", "fold"), y: str = "y",
                yhat: str = "yhat") -> DataFrame:
    """C6 per (model, fold): rmse = sqrt(mean squared error), mae."""
    err = F.col(yhat) - F.col(y)
    return (preds.groupBy(*group_cols)
                 .agg(F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae")))


def cv_report(scores: DataFrame, group_cols=("group", "name")) -> DataFrame:
    """Per model mean and population std over folds (numpy's default ddof=0)."""
    return (scores.groupBy(*group_cols)
                  .agg(F.avg("mae").alias("mae"), F.stddev_pop("mae").alias("mae_std"),
                       F.avg("rmse").alias("rmse"), F.stddev_pop("rmse").alias("rmse_std")))


def seed_report(runs: DataFrame, name_col: str = "name", ddof: int = 1) -> DataFrame:
    """Per model mean and std of the fold-averaged errors over seeds."""
    sd = F.stddev_samp if ddof == 1 else F.stddev_pop
    return (runs.groupBy(name_col)
                .agg(F.avg("mae").alias("mae_mean"), sd("mae").alias("mae_std"),
                     F.avg("rmse").alias("rmse_mean"), sd("rmse").alias("rmse_std"),
                     F.count(F.lit(1)).alias("n_seeds")))


def _binary_counts(df: DataFrame, label: str, pred: str, group_cols=()):
    l, p = F.col(label), F.col(pred)
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((l == 1) & (p == 1)).alias("tp"), F.count_if((l == 0) & (p == 1)).alias("fp"),
        F.count_if((l == 1) & (p == 0)).alias("fn"), F.count_if((l == 0) & (p == 0)).alias("tn"),
        F.count_if(l == p).alias("correct"))


def accuracy(df: DataFrame, label: str = "label", pred: str = "pred", group_cols=()) -> DataFrame:
    """C1."""
    return df.groupBy(*group_cols).agg(
        (F.count_if(F.col(label) == F.col(pred)).cast("double") / F.count(F.lit(1))).alias("acc"))


def _f1_expr() -> Column:
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))


def acc_and_f1(df: DataFrame, label: str = "label", pred: str = "pred", group_cols=()) -> DataFrame:
    """Accuracy, binary F1 (positive class 1; 0 when undefined) and their mean."""
    c = _binary_counts(df, label, pred, group_cols)
    acc = F.col("correct").cast("double") / F.col("n")
    return c.select(*group_cols, acc.alias("acc"), _f1_expr().alias("f1"),
                    ((acc + _f1_expr()) / 2).alias("acc_and_f1"))


def mcc(df: DataFrame, label: str = "label", pred: str = "pred", group_cols=()) -> DataFrame:
    """Matthews correlation for any number of classes from the grouped
    confusion matrix; 0 when undefined.
        mcc = (c*s - sum_k t_k p_k) / sqrt((s^2 - sum p_k^2)(s^2 - sum t_k^2))
    """
    gc = list(group_cols)
    dummy = not gc
    if dummy:  # one global group keyed by a constant, so every join is an equi-join
        df, gc = df.withColumn("_g", F.lit(0)), ["_g"]
    cm = df.groupBy(*gc, label, pred).agg(F.count(F.lit(1)).alias("m"))
    t = cm.groupBy(*gc, F.col(label).alias("k")).agg(F.sum("m").alias("t_k"))
    p = cm.groupBy(*gc, F.col(pred).alias("k")).agg(F.sum("m").alias("p_k"))
    tp = t.join(p, gc + ["k"], "full_outer").fillna(0, ["t_k", "p_k"])
    per = tp.groupBy(*gc).agg(F.sum(F.col("t_k").cast("double") * F.col("p_k")).alias("tp_sum"),
                              F.sum(F.col("t_k").cast("double") * F.col("t_k")).alias("tt"),
                              F.sum(F.col("p_k").cast("double") * F.col("p_k")).alias("pp"))
    tot = cm.groupBy(*gc).agg(F.sum(F.when(F.col(label) == F.col(pred), F.col("m")).otherwise(0))
                              .cast("double").alias("c"), F.sum("m").cast("double").alias("s"))
    j = tot.join(per, gc)
    den = F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt")))
    out = j.select(*gc, F.when(den > 0, (F.col("c") * F.col("s") - F.col("tp_sum")) / den)
                   .otherwise(F.lit(0.0)).alias("mcc"))
    return out.drop("_g") if dummy else out


def _corr(a: str, b: str) -> Column:
    """Pearson correlation; null when a column is constant (undefined)."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def pearson(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """C4 without ranks: Pearson, mean squared error and its root in one aggregate."""
    err = F.col(yhat) - F.col(y)
    return df.agg(_corr(y, yhat).alias("pearson"), F.avg(err * err).alias("mse"), F.sqrt(F.avg(err * err)).alias("rmse"))


def pearson_and_spearman(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """C4: Pearson, Spearman (Pearson of average ranks), their mean, and the
    mean squared error (the reference names it ``rmse``; named ``mse`` here)
    plus a true ``rmse``."""
    r = average_rank(df, y, "_ry")
    r = average_rank(r, yhat, "_rp")
    err = F.col(yhat) - F.col(y)
    return r.agg(_corr(y, yhat).alias("pearson"), _corr("_ry", "_rp").alias("spearman"),
                 F.avg(err * err).alias("mse"), F.sqrt(F.avg(err * err)).alias("rmse")) \
            .select("pearson", "spearman", ((F.col("pearson") + F.col("spearman")) / 2).alias("corr"),
                    "mse", "rmse")


TASK_METRICS = {  # fixed values: metric family per task
    "cola": "mcc", "sst-2": "acc", "mrpc": "acc_and_f1", "sts-b": "pearson_and_spearman",
    "qqp": "acc_and_f1", "mnli": "acc", "mnli-mm": "acc", "qnli": "acc", "rte": "acc", "wnli": "acc",
}


def compute_metrics(task: str, df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Metric dispatch by task; unknown task raises KeyError."""
    kind = TASK_METRICS[task]
    if kind == "mcc":
        return mcc(df, label, pred)
    if kind == "acc":
        return accuracy(df, label, pred)
    if kind == "acc_and_f1":
        return acc_and_f1(df, label, pred)
    return pearson_and_spearman(df, label, pred)


def stack_metrics(wide: DataFrame, metric_cols: list[str]) -> DataFrame:
    """Wide one-row metrics -> (metric, value) rows (feeds the K5 report)."""
    expr = "stack({}, {}) as (metric, value)".format(
        len(metric_cols), ", ".join(f"'{c}', cast(`{c}` as double)" for c in metric_cols))
    return wide.selectExpr(expr)


def cross_entropy(scores: str, label: str) -> Column:
    """Per-row softmax cross-entropy of a score array against a 0-based label."""
    s = F.transform(F.col(scores), lambda x: x.cast("double"))
    m = F.array_max(s)
    lse = F.log(F.aggregate(F.transform(s, lambda x: F.exp(x - m)), F.lit(0.0), lambda a, b: a + b)) + m
    return lse - F.element_at(s, F.col(label).cast("int") + 1)


def batch_mean_loss(df: DataFrame, order_col: str, loss_col: str, batch_size: int = 8) -> DataFrame:
    """Mean of per-batch mean losses (batches of consecutive rows; the last
    batch may be smaller, so this is not the row mean)."""
    idx = with_row_index(df.select(order_col, loss_col), order_col, "_i")
    per_batch = (idx.groupBy(F.floor(F.col("_i") / batch_size).alias("batch"))
                    .agg(F.avg(loss_col).alias("bl")))
    return per_batch.agg(F.avg("bl").alias("eval_loss"), F.count(F.lit(1)).alias("n_batches"))
