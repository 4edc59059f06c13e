"""the cross-validation plan as one long prediction table.

responses --(J3 surprisal lookup, J4 LMM lookup)--> modelling table
          --(F1 folds)--> per model out-of-fold predictions
          (group, name, fold, response_id, y, yhat) --(C6, G6)--> report.

Linear models use one aggregate for all folds; the fixed models are column
expressions; the forest and the networks are fitted for all folds side by side.  Nothing is positional: every row carries ``response_id``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import regress as R
from ..operators.features import one_hot
from ..operators.forest import forest_fold_predictions
from ..operators.indexing import assign_folds
from ..operators.metrics import cv_report, fold_scores
from ..operators.prep import lookup_join
from ..operators.surprisal import doc_surprisal_sums
from ..session import materialised
from . import fixtures as X

DATA_ONLY, FULL = "Data-Only", "Full_Results"


def modelling_table(t: X.Tables, k: int = 10, lmm_seconds: DataFrame | None = None) -> DataFrame:
    """Responses with numeric features, the article surprisal sum (J3) and
    optionally the LMM article seconds (J4), plus the fold column (F1).  The rows are computed once, into a
    written table; folds and models read that.

    ``num_words`` / ``surprisal`` are 0 when the article text is missing."""
    r = X.responses(t)
    surp = doc_surprisal_sums(t.documents)
    r = lookup_join(r, surp, "survey_num", "surprisal", lookup_key="doc_id")
    cols = [F.col("response_id"), F.col("survey_num"), F.col("person_id"), F.col("hour_of_day"),
            F.col("device"),
            F.coalesce(F.col("num_words"), F.lit(0)).cast("double").alias("x_words"),
            F.coalesce(F.col("surprisal"), F.lit(0.0)).alias("x_surp"),
            F.col("reading_time").alias("y")]
    # a missing article has no LMM seconds: predict 0 s (counted by data_checks)
    if lmm_seconds is not None:
        r = lookup_join(r, lmm_seconds.withColumnRenamed("seconds", "lmm_seconds"), "survey_num",
                        "lmm_seconds", lookup_key="doc_id")
        cols.append(F.coalesce(F.col("lmm_seconds"), F.lit(0.0)).alias("lmm_seconds"))
    return assign_folds(materialised(r.select(*cols), "responses"), "response_id", k)


def _preds(df: DataFrame, name: str, yhat) -> DataFrame:
    return df.select(F.lit(DATA_ONLY).alias("model_group"), F.lit(name).alias("name"), "fold",
                     "response_id", "y", yhat.alias("yhat"))


#: Linear models on one column of the modelling table.
ONE_FEATURE = {"lr-basic": ["x_words"], "lr-surp": ["x_surp"]}


def linear_predictions(tbl: DataFrame, name: str, x_cols: list[str], coefs=None) -> DataFrame:
    coefs = R.fit_ols_folds(tbl, x_cols, "y") if coefs is None else coefs
    scored = R.predict_linear_folds(tbl, coefs, x_cols)
    return _preds(scored, name, F.col("yhat"))


def full_feature_columns(tbl: DataFrame, keep_key: bool = True):
    """R5 design: numeric columns (the article key included as a number, as in
    the reference; ``keep_key=False`` drops it) plus a one-hot of the string
    columns."""
    wide = one_hot(tbl, ["device"])
    dummies = [c for c in wide.columns if c.startswith("device_")]
    nums = (["survey_num"] if keep_key else []) + ["person_id", "hour_of_day", "x_words"]
    return wide, nums + dummies


def data_only_predictions(tbl: DataFrame, models=("std", "lr-basic", "lr-surp"),
                          rf_trees: int = 100, rf_depth: int | None = None, knn_k: int = 5, mlp_epochs: int = 100,
                          seed: int = 42) -> DataFrame:
    parts = []
    small = {m: ONE_FEATURE[m] for m in models if m in ONE_FEATURE}
    fitted = R.fit_ols_models(tbl, small, "y") if small else {}
    for m in models:
        if m == "std":
            parts.append(_preds(tbl, m, F.col("x_words") / F.lit(4.0)))
        elif m in fitted:
            parts.append(linear_predictions(tbl, m, small[m], fitted[m]))
        elif m == "lmm":
            parts.append(_preds(tbl, m, F.col("lmm_seconds")))
        elif m == "lr":
            wide, cols = full_feature_columns(tbl)
            parts.append(linear_predictions(wide, m, cols))
        elif m == "rf":
            wide, cols = full_feature_columns(tbl)
            p = forest_fold_predictions(wide, cols, "response_id", "y", num_trees=rf_trees, max_depth=rf_depth, seed=seed)
            parts.append(_preds(p, m, F.col("yhat")))
        elif m == "knn":
            from ..operators.knn import knn_fold_predictions
            wide, cols = full_feature_columns(tbl)
            p = knn_fold_predictions(wide, cols, "response_id", "y", k=knn_k)
            parts.append(_preds(p, m, F.col("yhat")))
        elif m == "mlp":
            from ..operators.mlp import mlp_fold_predictions
            wide, cols = full_feature_columns(tbl)
            p = mlp_fold_predictions(wide, cols, "response_id", "y", epochs=mlp_epochs, seed=seed)
            parts.append(_preds(p, m, F.col("yhat")))
        else:
            raise KeyError(m)
    return reduce(lambda a, b: a.unionByName(b), parts)


def report(preds: DataFrame) -> DataFrame:
    return cv_report(fold_scores(preds, ("model_group", "name", "fold")), ("model_group", "name"))


def full_predictions(tbl: DataFrame, texts: DataFrame, embedders: dict, epochs: int = 100, seed: int = 42) -> DataFrame:
    """R8-R10 in one training run: the network on the response features (``mlp``), and for
    each of ``embedders`` ({name: (embedding of a table of texts, width, words to keep or
    None)}) on the text's embedding alone and on both stacked (J6).  ``texts`` has
    survey_num and text; each distinct text is embedded once (J5)."""
    from ..operators import embed as EM
    from ..operators import mlp as NN
    wide, cols = full_feature_columns(tbl)
    base = list(range(len(cols)))
    nets, parts, at = {"mlp": base}, [F.array(*[F.col(c).cast("double") for c in cols])], len(base)
    for name, (embed, width, words) in embedders.items():
        vec = f"_emb_{name}"
        emb = EM.embed_distinct(texts, "text", embed, shorten=words).select("survey_num", F.col("embedding").alias(vec))
        wide = EM.with_zero_fill(wide.join(emb, "survey_num", "left"), vec, width)
        parts.append(F.transform(vec, lambda v: v.cast("double")))
        own = list(range(at, at + width))
        nets[name], nets[f"{name}/MLP"], at = own, base + own, at + width
    data = wide.select("response_id", "fold", "y", F.concat(*parts).alias("_x")).persist()
    thetas, sizes, std, _ = NN.fit_networks(data, "_x", "y", nets, epochs=epochs, seed=seed, key="response_id")
    scored = NN.predict_networks(data, "response_id", "_x", "y", nets, thetas, sizes, std)
    group = F.when(F.col("name") == "mlp", F.lit(DATA_ONLY)).otherwise(F.lit(FULL))
    return scored.select(group.alias("model_group"), "name", "fold", "response_id", "y", "yhat")


#: Header of the result table.
RESULT_COLUMNS = {"model_group": "Group", "name": "Name", "mae": "MAE", "mae_std": "MAE-STD", "rmse": "RMSE", "rmse_std": "RMSE-STD"}


def write_results(rep: DataFrame, path: str) -> None:
    """K3: the report as a CSV table with the result columns."""
    from ..sources import write_csv_table
    write_csv_table(rep.select(*[F.col(c).alias(n) for c, n in RESULT_COLUMNS.items()]), path)


def read_results(spark, path: str) -> DataFrame:
    from ..sources import read_csv_table
    kinds = ", ".join(f"{n} {'string' if n in ('Group', 'Name') else 'double'}" for n in RESULT_COLUMNS.values())
    back = read_csv_table(spark, path, kinds, multiline=False)
    return back.select(*[F.col(f"`{n}`").alias(c) for c, n in RESULT_COLUMNS.items()])
