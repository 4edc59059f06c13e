from pyspark.sql import functions as F

from lectio.functions import text as T
from lectio.operators.features import one_hot, text_features


def test_tokens_rules(spark):
    df = spark.createDataFrame([(1, "Don't stop, it's 3.5 km!"), (2, ""), (3, "?")], "id long, text string")
    rows = {r.id: r.t for r in df.select("id", T.tokens("text").alias("t")).collect()}
    assert rows[1] == ["Don't", "stop", ",", "it's", "3", ".", "5", "km", "!"]
    assert rows[2] == []
    assert rows[3] == ["?"]


def test_truncate_words_keeps_split_semantics(spark):
    df = spark.createDataFrame([("a  b c",)], "text string")
    assert df.select(T.truncate_words("text", 2).alias("x")).first().x == "a "


def test_text_features_empty_text_is_null_ratio(spark):
    df = spark.createDataFrame([(1, ""), (2, "Hello there. General Kenobi!")], "doc_id long, text string")
    r = {x.doc_id: x for x in text_features(df).collect()}
    assert r[1].num_words == 0 and r[1].syll_per_word is None
    assert r[2].num_words == 4 and r[2].n_sentences == 2 and r[2].words_per_sent == 2.0
    assert r[2].n_unique == 4


def test_one_hot_null_is_all_zero_and_sorted_names(spark):
    df = spark.createDataFrame([(1, "b x"), (2, None), (3, "a")], "id long, c string")
    out = one_hot(df, ["c"])
    assert out.columns == ["id", "c_a", "c_b x"]
    r = {x.id: (x["c_a"], x["c_b x"]) for x in out.collect()}
    assert r == {1: (0, 1), 2: (0, 0), 3: (1, 0)}


def test_no_python_udf_in_text_plan(spark):
    df = spark.createDataFrame([(1, "x y")], "doc_id long, text string")
    plan = text_features(df)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert F  # keep import


def test_sentence_position_sums_match_sequential_rule(spark):
    import random

    import regex

    from lectio.operators.surprisal import doc_token_sums

    rx = regex.compile(T.TOKEN_PATTERN)
    rnd = random.Random(11)
    alphabet = list("ab c.!?'’ é1,") + ["  ", "..."]
    texts = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))) for i in range(200)]
    got = {r.doc_id: (r.n_tokens, r.wlen, r.sentpos)
           for r in doc_token_sums(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, t in texts:
        toks = rx.findall(t)
        last, sp = 0, 0
        for pos, tok in enumerate(toks, start=1):
            sp += pos - last
            if tok in (".", "!", "?"):
                last = pos
        assert got[i] == (len(toks), sum(len(x) for x in toks), sp), (i, t)
