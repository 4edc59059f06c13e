"""Less data moved: hot keys of written tables, story lists, texts rebuilt once, alignment of odd rows."""

from pyspark.sql import functions as F

from lectio.operators import align as A
from lectio.operators import prep as P


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_rows_of_a_written_table_stay(spark, monkeypatch):
    monkeypatch.setattr(P, "HOT_SHARE", 1 / 10)
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(["a"] * 50 + ["b", "c", "d"] * 3 + [None] * 4 + ["zz"])], "i long, k string")
    lookup = spark.createDataFrame([("a", 1.0, 50), ("b", 2.0, 3), ("c", None, 3), ("d", 4.0, 3)], "k string, v double, n long")
    far = P.join_by_key(rows, lookup, ["k"], "n", 59, 1 << 40)
    near = P.join_by_key(rows, lookup, ["k"], "n", 59, 1 << 40, reread=True)
    assert far.columns == near.columns
    assert sorted(map(str, far.collect())) == sorted(map(str, near.collect()))
    # the union's first branch is a broadcast join without an exchange of rows
    assert "LeftAnti" in _plan(near) and "LeftAnti" not in _plan(far)


def test_odd_rows_align_as_tables_do(spark):
    rows = spark.createDataFrame([
        (1, ["a.b", "go", "The"], ["a", ".", "b", "go", "The"]),
        (1, ["go"], ["Go"]),                                  # the same story twice, pieces that differ by case
        (2, ["x", "y", "z"], ["x"]),                          # fewer tokens than words
        (3, ["x"], None),
        (4, [], ["x"]),
        (5, ["x-y", "q"], ["x", "-"]),
    ], "item long, words array<string>, tokens array<string>")
    got = {(r.item, r.zone, r.word): (r.pieces, r.n_tok, r.wlen, r.sentpos, r.sentpos_first, r.matched) for r in A.align_arrays(rows).collect()}
    assert got == {
        (1, 1, "a.b"): ("a.b", 3, 3, 4, 1, 1), (1, 2, "go"): ("go", 1, 2, 2, 2, 1), (1, 3, "The"): ("The", 1, 3, 3, 3, 1),
        (1, 1, "go"): ("Go", 1, 2, 1, 1, 0),
        (2, 1, "x"): ("x", 1, 1, 1, 1, 1), (2, 2, "y"): ("", 0, None, None, None, 0), (2, 3, "z"): ("", 0, None, None, None, 0),
        (3, 1, "x"): (None, None, None, None, None, None),
        (5, 1, "x-y"): ("x-", 2, 2, 3, 1, 0), (5, 2, "q"): ("", 0, None, None, None, 0)}


def test_stories_are_shuffled_before_they_are_listed(spark):
    words = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (None, 1, "n"), (2, 1, "c")], "item long, zone long, word string")
    out = A.story_texts(words)
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "a b"), (2, "c"), (None, "n")]
    assert "REPARTITION_BY_COL" in _plan(out)


def test_story_files_rebuild_the_texts_once(spark, monkeypatch):
    from lectio import session
    from lectio.plans.registry import QUERIES
    from conftest import SF
    names, plain = [], session.materialised
    monkeypatch.setattr(session, "materialised", lambda df, name: names.append(name) or plain(df, name))
    assert QUERIES["story_files"](spark, SF).select("variant").distinct().count() == 2
    assert names == ["story-texts"]
