"""Sparse one-hot against the dense one, with many categories and hot ones."""

from pyspark.sql import functions as F

from lectio.operators.features import one_hot, one_hot_sparse


def test_same_layout_as_dense(spark):
    rows = [(1, "b", "x"), (2, "a", None), (3, None, "y"), (4, "b", "y"), (5, "c", "x"), (6, None, None)]
    df = spark.createDataFrame(rows, "id long, u string, v string")
    dense = one_hot(df, ["u", "v"])
    cols = [c for c in dense.columns if c != "id"]
    want = {r["id"]: [r[c] for c in cols] for r in dense.collect()}
    for r in one_hot_sparse(df, ["u", "v"]).collect():
        got = [0] * r.one_hot["size"]
        for i, v in zip(r.one_hot["indices"], r.one_hot["values"]):
            got[i] = v
        assert got == want[r.id] and len(got) == 5


def test_a_hundred_thousand_categories(spark):
    df = spark.range(150_000).select("id", F.when(F.col("id") < 50_000, "hot").otherwise(F.col("id").cast("string")).alias("c"))
    got = one_hot_sparse(df, ["c"])
    assert len(got.columns) == 2
    r = got.agg(F.min("one_hot.size").alias("lo"), F.max("one_hot.size").alias("hi"), F.countDistinct(F.col("one_hot.indices")[0]).alias("n"),
                F.max(F.col("one_hot.indices")[0]).alias("top"), F.count("id").alias("rows")).first()
    assert (r.lo, r.hi, r.n, r.top, r.rows) == (100_001, 100_001, 100_001, 100_000, 150_000)
