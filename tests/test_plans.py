"""Plan-shape tests: native operators stay in the JVM, lookups broadcast,
k-NN never builds a cross product, top-k is pruned per partition."""

from pyspark.sql import functions as F

from lectio.operators.knn import knn_fold_predictions
from lectio.operators.prep import lookup_join
from lectio.operators.surprisal import token_surprisal


def _plan(df):
    df.count()  # materialise so the adaptive plan is final
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookup_join_broadcasts_small_side(spark):
    big = spark.range(20000).withColumnRenamed("id", "k")
    small = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plan = lookup_join(big, small, "k", "v")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_token_table_is_native(spark):
    docs = spark.createDataFrame([(1, "A b. C d!"), (2, "e f")], "doc_id long, text string")
    plan = _plan(token_surprisal(docs))
    assert "Python" not in plan


def test_knn_has_no_cross_product(spark):
    rows = [(i, i % 5, float(i % 7), float(i * 13 % 11), float(i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "key long, fold long, a double, b double, y double")
    out = knn_fold_predictions(df, ["a", "b"], "key", "y", k=3)
    plan = out._jdf.queryExecution().executedPlan().toString() + _plan(out)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
