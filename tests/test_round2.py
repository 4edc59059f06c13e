"""Readers by header, regressions at wide scales, folds from boundary keys, metrics in odd cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectio.operators import metrics as M
from lectio.operators.indexing import assign_folds
from lectio.operators.regress import _solve
from lectio.sources import read_csv_table, read_json_map, read_raw_lines, read_token_outputs, write_split_text


@pytest.mark.parametrize("top", [1e4, 1e6, 1e7, 1e9])
def test_solve_keeps_small_columns_beside_a_wide_key(top):
    rng = np.random.default_rng(1)
    n = 4000
    dev = rng.integers(0, 3, n)
    x = np.column_stack([rng.integers(0, int(top), n).astype(float), rng.integers(0, 24, n).astype(float), rng.normal(300, 50, n),
                         *[(dev == k).astype(float) for k in range(3)], np.full(n, 5.0)])
    y = 3.0 + x @ np.array([1e-9, 2.0, 0.25, 10.0, -20.0, 5.0, 0.0])
    b0, b = _solve(dict(n=float(n), sy=y.sum(), sx=x.sum(0), sxy=x.T @ y, sxx=x.T @ x))
    assert np.sqrt(np.mean((b0 + x @ b - y) ** 2)) < 1e-4
    design = np.column_stack([np.ones(n), x])
    want = design @ np.linalg.lstsq(design, y, rcond=None)[0]
    assert np.allclose(b0 + x @ b, want, atol=1e-3)


def test_token_files_by_name_and_malformed(spark, tmp_path):
    d = tmp_path / "wide"
    d.mkdir()
    (d / "5.output-tok").write_text('word sentid sentpos wlen surp entropy entred\n" 1 2 3 7.5 0.1 0.2\nb 1 3 1 0.5 0.1 0.2\n')
    got = read_token_outputs(spark, str(d), "word string, wlen long, sentpos long, surp double").orderBy("sentpos").collect()
    assert [(r.word, r.wlen, r.sentpos, r.surp, r.doc_key) for r in got] == [('"', 3, 2, 7.5, "5"), ("b", 1, 3, 0.5, "5")]
    with pytest.raises(ValueError):
        read_token_outputs(spark, str(d), "word string, other double")
    (d / "6.output-tok").write_text("word sentid sentpos wlen surp entropy entred\nc 1 x 3 7.5 0.1 0.2\n")
    with pytest.raises(Exception, match="not a long"):
        read_token_outputs(spark, str(d), "word string, wlen long, sentpos long, surp double").collect()
    e = tmp_path / "mixed"
    e.mkdir()
    (e / "1.output-tok").write_text("word wlen sentpos surp\na 1 1 2.0\n")
    (e / "2.output-tok").write_text("word surp sentpos wlen\na 2.0 1 1\n")
    with pytest.raises(Exception):
        read_token_outputs(spark, str(e), "word string, wlen long, sentpos long, surp double").collect()


def test_csv_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text(',text,survey_num\n0,"two\nlines ""q""",7\n1,,8\n')
    got = {r.survey_num: r.text for r in read_csv_table(spark, str(tmp_path / "t.csv"), "survey_num long, text string").collect()}
    assert got == {7: 'two\nlines "q"', 8: None}


def test_json_object_over_lines_and_broken(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "1": 2.0,\n "20": 0.5\n}\n')
    (tmp_path / "b.json").write_text('{"3": 1.0}\n{"4": 1.5}\n')
    assert {r.k: r.v for r in read_json_map(spark, str(tmp_path), "k", "v", key_type="long").collect()} == {1: 2.0, 20: 0.5, 3: 1.0, 4: 1.5}
    (tmp_path / "c.json").write_text("not json\n")
    with pytest.raises(Exception):
        read_json_map(spark, str(tmp_path), "k", "v").collect()


def test_raw_lines_keep_later_marks(spark, tmp_path):
    (tmp_path / "x.txt").write_text("﻿one\n﻿two\n", encoding="utf-8")
    assert [(r.line_no, r.line) for r in read_raw_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == [(0, "one"), (1, "﻿two")]


def test_split_text_buckets_follow_size(spark, tmp_path):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', 100)").alias("text"))
    write_split_text(docs, str(tmp_path / "s"), bucket_bytes=10_000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 200 and back.select("bucket").distinct().count() == 5


@pytest.mark.parametrize("n", [3, 10, 23, 1003])
def test_folds_from_boundary_keys(spark, n):
    df = spark.range(n).select((F.col("id") * 7 % 100_003).alias("key"), F.lit("wide").alias("w"))
    got = [r.fold for r in assign_folds(df, "key", 10).orderBy("key").collect()]
    sizes = [n // 10 + (f < n % 10) for f in range(10)]
    assert got == [f for f in range(10) for _ in range(sizes[f])]


def test_mcc_with_huge_counts(spark):
    cm = spark.createDataFrame([(0, 0, 4_000_000_000), (1, 1, 4_000_000_000), (0, 1, 1_000), (1, 0, 1_000)], "t long, p long, m long")
    per = cm.groupBy().agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("x")).first()["x"]
    assert per > 3e19          # the same product in whole numbers overflows
    rows = [(0, 0)] * 5 + [(1, 1)] * 4 + [(2, 2)] * 3 + [(0, 1), (2, 0)]
    got = M.mcc(spark.createDataFrame(rows, "label long, pred long")).first()["mcc"]
    t, p = np.array(rows).T
    c, s = (t == p).sum(), len(rows)
    tk, pk = np.bincount(t, minlength=3), np.bincount(p, minlength=3)
    assert abs(got - (c * s - tk @ pk) / np.sqrt((s * s - pk @ pk) * (s * s - tk @ tk))) < 1e-12


def test_pearson_of_a_constant_is_undefined(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "y double, yhat double")
    r = M.pearson(df).first()
    assert r["pearson"] is None and abs(r["mse"] - 7.0) < 1e-12
    both = M.pearson_and_spearman(df).first()
    assert both["pearson"] is None and both["spearman"] is None
