"""One evaluation of the tokens per pass, positions only where they are read, frequent pairs not shuffled."""

import math
import re
from collections import Counter

from lectio.functions import text as T
from lectio.operators import prep as P
from lectio.operators import surprisal as S

TEXTS = {1: "a b a b . a c", 2: "A b ! b", 3: "", 4: None, 5: "c"}


def _docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")


def test_sums_do_not_build_sentence_positions(spark):
    """F30, F31, F33, F34."""
    tt = S.token_surprisal(_docs(spark))
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
    assert "sequence(" in plan(tt)
    per = plan(S.surprisal_per_doc(tt, "doc_id"))
    assert "sequence(" not in per and per.count("regexp_extract_all") == 1
    got = {(r.doc_id, r.tok_pos): (r.word, r.sentpos) for r in tt.collect()}
    assert got == {(1, 1): ("a", 1), (1, 2): ("b", 2), (1, 3): ("a", 3), (1, 4): ("b", 4), (1, 5): (".", 5), (1, 6): ("a", 1), (1, 7): ("c", 2),
                   (2, 1): ("A", 1), (2, 2): ("b", 2), (2, 3): ("!", 3), (2, 4): ("b", 1), (5, 1): ("c", 1)}


def test_frequent_pairs_are_not_shuffled(spark, monkeypatch):
    """beyond the broadcast the most frequent pairs that fit stay in place; the table is the same."""
    monkeypatch.setattr(P, "LOOKUP_BYTES", 0)
    monkeypatch.setattr(S, "VOCABULARY_BYTES", 250)
    out = S.bigram_table(_docs(spark).select("doc_id", T.tokens("text").alias("tokens")), "doc_id")
    assert "Union" in out._jdf.queryExecution().optimizedPlan().toString()
    words = {d: re.findall(r"\w|[.!]", (t or "").lower()) for d, t in TEXTS.items()}
    pairs = {(d, i): (([S.START] + w)[i - 1], w[i - 1]) for d, w in words.items() for i in range(1, len(w) + 1)}
    n, after, voc = Counter(pairs.values()), Counter(v for v, _ in pairs.values()), len({w for _, w in pairs.values()})
    want = {k: (v, round(-math.log2((n[v, w] + 1) / (after[v] + voc)), 9)) for k, (v, w) in pairs.items()}
    assert {(r.doc_id, r.tok_pos): (r.prev, round(r.surp, 9)) for r in out.collect()} == want
