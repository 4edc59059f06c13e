import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectio.operators import metrics as M
from lectio.operators.align import join_word_rt
from lectio.operators.prep import expect, lookup_join
from lectio.sources import write_split_text


def test_cv_report_uses_population_std_and_seed_report_sample_std(spark):
    rows = [("m", f, float(f), float(2 * f)) for f in range(10)]
    s = spark.createDataFrame(rows, "name string, fold long, mae double, rmse double")
    r = M.cv_report(s, ("name",)).first()
    assert abs(r.mae_std - np.std(np.arange(10.0))) < 1e-12
    runs = spark.createDataFrame([("m", 1, 1.0, 2.0), ("m", 2, 3.0, 4.0)], "name string, seed long, mae double, rmse double")
    g = M.seed_report(runs).first()
    assert abs(g.mae_std - np.std([1.0, 3.0], ddof=1)) < 1e-12 and g.n_seeds == 2
    g0 = M.seed_report(runs, ddof=0).first()
    assert abs(g0.mae_std - 1.0) < 1e-12


def test_missing_rt_and_missing_lookup_key_raise(spark):
    words = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "item long, zone long, word string")
    rts = spark.createDataFrame([("a", 1, 1, 0, 300.0)], "word string, zone long, item long, subject long, meanItemRT double")
    j = join_word_rt(words, rts)
    with pytest.raises(AssertionError):
        expect(j, F.col("rt").isNotNull(), "reading time per word")
    df = spark.createDataFrame([(1,), (5,)], "k long")
    lk = spark.createDataFrame([(1, 2.0)], "k long, v double")
    with pytest.raises(AssertionError):
        lookup_join(df, lk, "k", "v", on_missing="raise")


def test_split_text_layout_prunes_by_bucket(spark):
    docs = spark.createDataFrame([(i, f"Text {i}, with words.") for i in range(50)], "doc_id long, text string")
    out = tempfile.mkdtemp(prefix="lectio-split-") + "/t"
    write_split_text(docs, out, buckets=4)
    back = spark.read.parquet(out)
    assert back.count() == 100
    one = back.where((F.col("variant") == "tok") & (F.col("doc_id") == 7)).collect()
    assert one[0].text == "Text 7 , with words ."
    plan = back.where(F.col("bucket") == 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan


def test_evaluate_classification_and_regression(spark):
    import numpy as np

    from lectio.operators.evaluate import evaluate
    rng = np.random.RandomState(0)
    ids = rng.randint(0, 50, size=(21, 4))
    label = rng.randint(0, 2, 21)
    rows = [(i, int(label[i]), [int(v) for v in ids[i]], [1, 1, 1, int(i % 2)], [0] * 4) for i in range(21)]
    df = spark.createDataFrame(rows, "i long, label long, input_ids array<long>, input_mask array<int>, segment_ids array<int>").repartition(3)

    def model():
        return lambda x, mask, seg: np.stack([(x * mask).sum(1) % 7 / 3.0, (x * mask).sum(1) % 5 / 2.0], axis=1)
    s = model()(ids, np.array([r[3] for r in rows]), None)
    pred = s.argmax(1)
    loss = np.log(np.exp(s).sum(1)) - s[np.arange(21), label]
    got = {r.metric: r.value for r in evaluate(df, model, "rte", "i").collect()}
    assert abs(got["acc"] - (pred == label).mean()) < 1e-12
    assert abs(got["eval_loss"] - np.mean([loss[k:k + 8].mean() for k in (0, 8, 16)])) < 1e-12
    got = {r.metric: r.value for r in evaluate(df, model, "sts-b", "i", batch_size=5).collect()}
    sq = (s[:, 0] - label) ** 2
    assert abs(got["mse"] - sq.mean()) < 1e-12 and abs(got["eval_loss"] - np.mean([sq[k:k + 5].mean() for k in range(0, 21, 5)])) < 1e-12


def test_models_from_one_aggregate_equal_models_alone(spark):
    from lectio.operators.regress import fit_ols_folds, fit_ols_models
    df = spark.range(40).selectExpr("id % 4 as fold", "cast(id as double) as a", "cast(id * id % 7 as double) as b", "cast(3 * id + id % 5 as double) as y")
    both = fit_ols_models(df, {"one": ["a"], "two": ["b"], "all": ["a", "b"]}, "y")
    for name, cols in (("one", ["a"]), ("two", ["b"]), ("all", ["a", "b"])):
        alone = fit_ols_folds(df, cols, "y")
        assert all(abs(both[name][f][0] - alone[f][0]) < 1e-9 and abs(both[name][f][1] - alone[f][1]).max() < 1e-9 for f in alone)
