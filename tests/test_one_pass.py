"""Token tables and alignment taken inside the rows equal the windowed forms; split vocabulary joins."""

import random

import pytest
from pyspark.sql import functions as F

from lectio.functions import text as T
from lectio.operators import align as A
from lectio.operators import surprisal as S


def _docs(spark):
    rng = random.Random(5)
    bits = ["one", "can't", "go.", "end!", "(a", "b)", "x-y", "...", "Ünï", "İs", " ", "42,", "?", "the", "the"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(1, 60)))) for i in range(30)]
    return spark.createDataFrame(rows + [(90, ""), (91, None), (92, "   "), (93, "." * 300)], "doc_id long, text string")


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _near(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:-1] == y[:-1] and abs(x[-1] - y[-1]) < 1e-9


def test_array_token_table_equals_windowed(spark):
    docs = _docs(spark)
    _near(_rows(S.token_surprisal(docs)), _rows(S.token_table(S.explode_tokens(docs), "doc_id", block=7)))


def test_split_vocabulary_gives_the_same(spark, monkeypatch):
    docs = _docs(spark)
    whole, sums = _rows(S.token_surprisal(docs)), _rows(S.doc_surprisal_sums(docs))
    monkeypatch.setattr(S, "VOCABULARY_BYTES", 0)
    for head in (3, 8, 10 ** 9):
        monkeypatch.setattr(S, "HEAD_WORDS", head)
        _near(_rows(S.token_surprisal(docs)), whole)
        _near(_rows(S.doc_surprisal_sums(docs)), sums)


def test_text_positions_equal_word_positions(spark):
    docs = _docs(spark)
    words = (docs.select("doc_id", F.posexplode(T.whitespace_words("text")).alias("p", "word"))
                 .select(F.col("doc_id").alias("item"), (F.col("p") + 1).cast("long").alias("zone"), "word"))
    cols = ["item", "zone", "_w", "_span", "tok_pos"]
    got = A.text_positions(docs.withColumnRenamed("doc_id", "item")).select(*cols)
    assert _rows(got) == _rows(A.word_positions(words).select(*cols))


def test_bigram_table_by_hand(spark):
    docs = spark.createDataFrame([(1, ["A", "b", "a"]), (2, ["a", "B"]), (3, []), (4, None)], "doc_id long, tokens array<string>")
    got = {(r.doc_id, r.tok_pos): (r.word, r.prev, round(r.surp, 9)) for r in S.bigram_table(docs, "doc_id").collect()}
    import math
    # pairs: <s>a 2, ab 2, ba 1; V = 2
    assert got == {(1, 1): ("A", "<s>", round(-math.log2(3 / 4), 9)), (1, 2): ("b", "a", round(-math.log2(3 / 4), 9)),
                   (1, 3): ("a", "b", round(-math.log2(2 / 3), 9)), (2, 1): ("a", "<s>", round(-math.log2(3 / 4), 9)),
                   (2, 2): ("B", "a", round(-math.log2(3 / 4), 9))}


def test_alignment_branches_share_their_exchanges(spark):
    docs = _docs(spark)
    toks = S.array_token_table(docs.select(F.col("doc_id").alias("item"), T.tokens("text").alias("tokens")), "item")
    al = A.align_positions(A.text_positions(docs.withColumnRenamed("doc_id", "item")), toks.hint("shuffle_merge"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = al._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("ReusedExchange") >= 2


@pytest.mark.parametrize("room, limit", [(900, 1), (260, 3)])
def test_head_of_a_large_vocabulary_fills_its_room(spark, monkeypatch, room, limit):
    """The head is what fits, not only the hottest words; where only single words are left, nothing is shuffled."""
    from collections import Counter

    words = ["a"] * 9 + ["b"] * 5 + ["c"] * 4 + ["e"] * 4 + ["d"] * 2 + ["f"] * 3 + [f"w{i}" for i in range(40)]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(99, None)], "id long, _key string")
    monkeypatch.setattr(S, "VOCABULARY_BYTES", room)
    monkeypatch.setattr(S, "HEAD_WORDS", 5)
    counted = S.corpus_counts(rows.where("_key is not null"))
    assert S.head_limit(counted) == limit
    got = S.join_counts(rows, counted)
    want = Counter(words)
    assert sorted((r["id"], r["_c"]) for r in got.collect()) == [(i, want[w]) for i, w in enumerate(words)]
    plan = got._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert ("Union" in plan) == (limit > 1)
