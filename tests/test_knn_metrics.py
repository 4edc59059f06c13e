import numpy as np
import pandas as pd

from lectio.operators import metrics as M
from lectio.operators.knn import knn_fold_predictions


def test_knn_exact_vs_brute_force_with_duplicates(spark):
    rng = np.random.RandomState(5)
    n = 400
    x1 = np.round(rng.lognormal(size=n) * 10, 1)
    x2 = rng.randint(0, 5, size=n).astype(float)
    x1[:60] = 3.0            # a hot coordinate
    x2[:60] = 1.0
    y = rng.normal(size=n)
    fold = np.repeat(np.arange(5), n // 5)
    pdf = pd.DataFrame({"key": np.arange(n), "x1": x1, "x2": x2, "y": y, "fold": fold})
    got = knn_fold_predictions(spark.createDataFrame(pdf), ["x1", "x2"], "key", "y", k=5, per_cell=8) \
        .toPandas().set_index("key")["yhat"]
    X = pdf[["x1", "x2"]].to_numpy()
    for i in range(n):
        m = fold != fold[i]
        d = ((X[m] - X[i]) ** 2).sum(1)
        keys = pdf["key"].to_numpy()[m]
        order = np.lexsort((keys, d))[:5]
        assert abs(got[i] - y[m][order].mean()) < 1e-9, i


def test_mcc_f1_degenerate_cases(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 0)], "label long, pred long")
    assert M.mcc(df).first().mcc == 0.0
    assert M.acc_and_f1(df).first().f1 == 0.0
    df2 = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (1, 0)], "label long, pred long")
    # sklearn-style multiclass MCC by hand
    C = np.zeros((3, 3))
    for l, p in [(0, 0), (1, 1), (2, 2), (1, 0)]:
        C[l, p] += 1
    t, p_, c, s = C.sum(1), C.sum(0), np.trace(C), C.sum()
    exp = (c * s - t @ p_) / np.sqrt((s * s - p_ @ p_) * (s * s - t @ t))
    assert abs(M.mcc(df2).first().mcc - exp) < 1e-12


def test_spearman_with_ties(spark):
    y = [1.0, 2.0, 2.0, 3.0, 5.0, 5.0]
    yh = [2.0, 1.0, 3.0, 3.0, 4.0, 6.0]
    df = spark.createDataFrame(list(zip(y, yh)), "y double, yhat double")
    r = M.pearson_and_spearman(df).first()
    ry, rp = pd.Series(y).rank(), pd.Series(yh).rank()
    assert abs(r.spearman - np.corrcoef(ry, rp)[0, 1]) < 1e-12
    assert abs(r.mse - np.mean((np.array(yh) - np.array(y)) ** 2)) < 1e-12


def test_knn_exact_when_folds_follow_coordinates(spark):
    # folds contiguous in the key and the key is the coordinate: every neighbour
    # cell of a query holds only its own fold, so rings must widen
    n = 200
    pdf = pd.DataFrame({"key": np.arange(n), "x1": np.arange(n, dtype=float), "x2": np.zeros(n),
                        "y": np.arange(n, dtype=float) % 7, "fold": np.arange(n) // 40})
    got = knn_fold_predictions(spark.createDataFrame(pdf), ["x1", "x2"], "key", "y", k=5, per_cell=2) \
        .toPandas().set_index("key")["yhat"]
    X = pdf[["x1", "x2"]].to_numpy()
    for i in range(n):
        m = pdf["fold"].to_numpy() != pdf["fold"][i]
        d = ((X[m] - X[i]) ** 2).sum(1)
        order = np.lexsort((pdf["key"].to_numpy()[m], d))[:5]
        assert abs(got[i] - pdf["y"].to_numpy()[m][order].mean()) < 1e-9, i
