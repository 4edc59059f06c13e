"""Round 4: compressed token tables, packed shuffles, and what they must not change."""

import os

from pyspark.sql import functions as F

from lectio.operators import align, indexing, mixedlm
from lectio.operators.indexing import even_parts, unzipped, zipped_parts


def _files(path, suffix):
    return [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(suffix) and not f.startswith((".", "_"))]


def _same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def _tokens(spark, n_docs=6, n=400):
    rows = [(d if d else None, p, None if p % 50 == 7 else f"w{(p * 7 + d) % 13}", p % 4, (p % 9) / 3) for d in range(n_docs) for p in range(1, n + 1)]
    return spark.createDataFrame(rows, "doc_id long, tok_pos long, word string, wlen long, surp double").coalesce(1)


def test_zipped_parts_come_back_row_by_row(spark, monkeypatch):
    rows = _tokens(spark)
    for limit in (500_000, 700):
        monkeypatch.setattr(indexing, "ZIP_ROWS", limit)
        zipped = zipped_parts(rows.withColumn("to", (F.col("tok_pos") % 3).cast("int")), "to", ["doc_id", "tok_pos"])
        assert zipped.count() <= 12                                     # a row a part of a task's stretch, not a row a token
        assert _same(unzipped(zipped.repartition(3, "part"), rows.schema, "tok_pos"), rows)
    odd = rows.select("word", "surp", F.when(F.col("tok_pos") != 30, -F.col("tok_pos")).cast("short").alias("p"), F.col("doc_id").cast("string"))
    for place in ("p", "doc_id"):
        assert _same(unzipped(zipped_parts(odd.withColumn("to", F.lit(1)), "to", [place]), odd.schema, place), odd)
    added = zipped_parts(rows.select("doc_id", "word", "surp", F.lit(0).alias("to")), "to", ["word"], "surp")
    fields = spark.createDataFrame([], "doc_id long, word string, surp double, surp_n long").schema
    want = rows.groupBy("doc_id", "word").agg(F.count("surp").alias("n"))
    assert _same(unzipped(added, fields, "word").groupBy("doc_id", "word").agg(F.sum("surp_n").alias("n")), want)


def test_even_parts_have_a_task_each(spark):
    df = spark.createDataFrame([(v,) for v in even_parts(spark, 16)], "v int").repartition(16, "v")
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() == 16


def test_group_moments_match_sql_in_any_stretch(spark, monkeypatch):
    rows = spark.range(3000).select(F.concat(F.lit("g"), (F.col("id") * F.col("id")) % 97).alias("g"), (F.col("id") % 7 / 3).alias("a"), F.rand(5).alias("b"), F.lit(0.1).alias("c"))
    stat = {"n": F.count(F.lit(1))} | {f"m{i}": F.avg(x) for i, x in enumerate("abc")}
    stat |= {f"c{i}_{j}": F.covar_pop("abc"[i], "abc"[j]) for i in range(3) for j in range(i, 3)}
    want = sorted(tuple(round(v, 9) for v in r) for r in rows.groupBy("g").agg(*[c.alias(n) for n, c in stat.items()]).select(*stat).collect())
    for limit in (1_000_000, 250):
        monkeypatch.setattr(mixedlm, "MOMENT_ROWS", limit)
        got = mixedlm.group_moments(rows, "g", ["a", "b", "c"])
        assert got.columns == list(stat)
        found = got.collect()
        assert all(r["c2_2"] == 0 for r in found)                       # equal values vary by nothing
        assert sorted(tuple(round(v, 9) + 0.0 for v in r) for r in found) == [tuple(v + 0.0 for v in r) for r in want]


def test_words_meet_reading_times_compressed(spark, monkeypatch):
    w = spark.range(4000).select((F.col("id") % 3).alias("item"), F.floor(F.col("id") / 3).alias("zone"), F.concat(F.lit("w"), F.col("id") % 11).alias("word"))
    r = w.select("word", "zone", "item", F.explode(F.array(F.lit(1.0), F.lit(4.0), F.lit(None).cast("double"))).alias("meanItemRT"))
    monkeypatch.setattr(indexing, "ZIP_ROWS", 300)                      # a word's reading times come from several stretches
    got = align.join_word_rt(w.unionByName(w), r.repartition(4))
    assert [(x.rt, x["count"]) for x in got.groupBy("rt").count().collect()] == [(2.5, 8000)]


def test_token_buckets_are_compressed_and_large_documents_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from lectio.sources import read_token_buckets, sinks, write_token_buckets
    monkeypatch.setattr(sinks, "TASK_ROWS", 3000)
    path = str(tmp_path / "t")
    rows = spark.range(30_000).select((F.col("id") % 2).alias("doc_id"), F.col("id").alias("tok_pos"), F.concat(F.lit("w"), F.col("id") % 5).alias("word"),
                                      (F.col("id") % 7 / 4).alias("surp")).repartition(4, "doc_id").sortWithinPartitions("doc_id", "tok_pos")
    write_token_buckets(rows, path, "doc_id", cols=("tok_pos", "word", "surp"), buckets=1)
    assert len(_files(path, ".csv.gz")) > 2 and not _files(path, ".csv")
    assert _same(read_token_buckets(spark, path, "doc_id long, tok_pos long, word string, surp double"), rows)
    assert [(r.n_buckets, r.n_keys, r.n_rows) for r in spark.read.parquet(f"{path}/_manifest").collect()] == [(1, 2, 30_000)]


def test_words_without_reading_times_are_counted_by_the_packed_join(spark):
    s = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None), (None, 1, "a"), (3, 5, "c")], "item long, zone long, word string")
    r = spark.createDataFrame([("a", 1, 1, None), ("b", 2, 1, 2.0), (None, 1, 2, 1.0), ("c", 4, 3, 1.0)], "word string, zone long, item long, meanItemRT double")
    none = align.join_word_rt(s, r.withColumn("there", F.lit(1.0)), rt="there").where("rt is null")
    want = s.join(r, ["word", "zone", "item"], "left_anti")            # a row without a value still is a row
    assert _same(none.select("word", "zone", "item"), want) and want.count() == 3


def test_bigrams_of_a_large_vocabulary_are_looked_up_compressed(spark, monkeypatch):
    from lectio.operators import surprisal
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.transform(F.sequence(F.lit(1), F.lit(80)), lambda i: F.concat(F.lit("W"), (i * i + F.col("id") % 7) % 23)).alias("tokens"))
    docs = docs.unionByName(docs.where("doc_id = 3")).coalesce(2)                    # a repeated document
    want = surprisal.bigram_table(docs, "doc_id").collect()
    monkeypatch.setattr(surprisal, "VOCABULARY_BYTES", 2_000)
    monkeypatch.setattr(indexing, "ZIP_ROWS", 900)
    got = surprisal.bigram_table(docs, "doc_id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    assert "MapInArrow" in plan and "SortMergeJoin" not in plan                     # no token crosses a shuffle as a row of its own


def test_lookups_and_sums_over_several_batches(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = spark.range(1000).select(F.col("id").alias("n"), F.when(F.col("id") % 10 != 3, (F.col("id") % 8).cast("string")).alias("k"))
        lookup = spark.createDataFrame([(str(i), i / 4) for i in range(6)] + [(None, 9.0)], "k string, v double")
        assert _same(indexing.looked_up(rows, lookup, ["k"], "v", ["n"]), rows.join(lookup, "k", "left").select("n", "k", "v"))
        summed = indexing.group_sums(rows.coalesce(1).sortWithinPartitions("k"), ["k"], "n")
        assert _same(summed, rows.groupBy("k").agg(F.sum("n").alias("n")))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_header_of_many_folders_is_read_from_one_file(spark, tmp_path, monkeypatch):
    from lectio.sources import read_token_outputs, readers, write_token_outputs
    path = str(tmp_path / "t")
    write_token_outputs(_tokens(spark, 5, 3).select("doc_id", "word", "wlen", F.col("tok_pos").alias("sentpos"), "surp").where("doc_id > 0"), path, "doc_id")
    asked, plain = [], readers.header_of
    monkeypatch.setattr(readers, "header_of", lambda reader, where: asked.append(where) or plain(reader, where))
    got = read_token_outputs(spark, path, "surp double, word string", glob="*.csv", key_pattern=r"/doc=([^/]+)/", key_col="doc_id")
    assert len(asked) == 1 and asked[0].endswith(".csv") and got.count() == 12
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == set("1234")


def test_wide_token_tables_are_written_where_they_lie(spark, tmp_path, monkeypatch):
    from lectio import session
    from lectio.operators.surprisal import token_surprisal
    from lectio.plans.registry import QUERIES
    docs = spark.createDataFrame([(i, "One two. Three, four five! " * 40) for i in range(20)] + [(20, ""), (21, None)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(session, "scratch_path", lambda spark, name: str(tmp_path / name))
    got = QUERIES["scan_token_wide"](spark, str(tmp_path))
    want = token_surprisal(docs).select("doc_id", "word", "sentpos", "wlen", F.round("surp", 6).alias("surp"))
    assert _same(got, want)
    files = _files(tmp_path / "token-wide", ".csv.gz")
    assert files and not _files(tmp_path / "token-wide", ".csv") and sum(map(os.path.getsize, files)) < 20 * 40 * 8 * 8          # of some 35 characters a token
