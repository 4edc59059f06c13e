"""The bucketed token layout: round trip, pruning, manifest."""

from pyspark.sql import functions as F

from lectio.sources import read_token_buckets, write_token_buckets

SCHEMA = "doc_id long, tok_pos long, word string, surp double"


def test_round_trip_and_pruned_read(spark, tmp_path):
    rows = [(d, p, w, d + p / 8) for d in range(40) for p, w in enumerate(['"', "it's", "é", "a"], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "t")
    write_token_buckets(df, path, "doc_id", cols=("tok_pos", "word", "surp"), buckets=8)
    assert sorted(map(tuple, read_token_buckets(spark, path, SCHEMA).collect())) == sorted(rows)
    some = read_token_buckets(spark, path, SCHEMA, keys=[3, 17, 999])
    assert sorted(map(tuple, some.collect())) == sorted(r for r in rows if r[0] in (3, 17))
    assert len({f.split("bucket=")[1].split("/")[0] for f in some.inputFiles()}) <= 3
    m = spark.read.parquet(path + "/_manifest").agg(F.sum("n_rows"), F.sum("n_keys"), F.max("n_buckets")).first()
    assert tuple(m) == (160, 40, 8)
    assert read_token_buckets(spark, path, "surp double, doc_id long").count() == 160
