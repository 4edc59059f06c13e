import itertools

from pyspark.sql import functions as F

from lectio.operators import encode as EN


def greedy(a, b, m):
    while a + b > m:
        if a > b:
            a -= 1
        else:
            b -= 1
    return a, b


def test_truncate_pair_closed_form_matches_greedy(spark):
    cases = [(a, b, m) for a, b, m in itertools.product(range(0, 30), range(0, 30), range(0, 50))]
    df = spark.createDataFrame(cases, "a int, b int, m int")
    # closed form per budget (budget is a literal in the operator)
    for m in (0, 1, 7, 20, 49):
        sub = df.where(F.col("m") == m)
        ka, kb = EN.truncate_pair_lengths(F.col("a"), F.col("b"), m)
        got = {(r.a, r.b): (r.ka, r.kb) for r in sub.select("a", "b", ka.alias("ka"), kb.alias("kb")).collect()}
        for (a, b), v in got.items():
            assert v == greedy(a, b, m), (a, b, m, v)


def _ref_encode(ids_a, ids_b, max_len, p: EN.Preset):
    """Straight transcription of the documented convention, in plain Python."""
    a, b = list(ids_a), (list(ids_b) if ids_b is not None else None)
    if b is not None:
        a_len, b_len = greedy(len(a), len(b), max_len - (4 if p.sep_extra else 3))
        a, b = a[:a_len], b[:b_len]
    else:
        a = a[:max_len - (3 if p.sep_extra else 2)]
    toks = a + [EN.SEP_ID] + ([EN.SEP_ID] if p.sep_extra else [])
    seg = [p.seg_a] * len(toks)
    if b:
        toks += b + [EN.SEP_ID]
        seg += [p.seg_b] * (len(b) + 1)
    if p.cls_at_end:
        toks, seg = toks + [EN.CLS_ID], seg + [p.cls_segment]
    else:
        toks, seg = [EN.CLS_ID] + toks, [p.cls_segment] + seg
    mask = [1] * len(toks)
    pad = max_len - len(toks)
    if p.pad_left:
        return [EN.PAD_ID] * pad + toks, [0] * pad + mask, [p.pad_segment] * pad + seg
    return toks + [EN.PAD_ID] * pad, mask + [0] * pad, seg + [p.pad_segment] * pad


def test_encode_matches_reference_convention(spark):
    rows = [(1, list(range(10, 30)), list(range(40, 47))), (2, list(range(10, 13)), None),
            (3, [], []), (4, list(range(10, 60)), None), (5, [7] * 9, [8] * 9)]
    df = spark.createDataFrame(rows, "k long, ids_a array<long>, ids_b array<long>")
    for name, preset in EN.PRESETS.items():
        for max_len in (8, 16, 33):
            out = EN.encode(df, max_len, preset).collect()
            for r in out:
                exp = _ref_encode(r.ids_a, r.ids_b, max_len, preset)
                assert (r.input_ids, r.input_mask, r.segment_ids) == tuple(map(list, exp)), (name, max_len, r.k)


def test_parse_layouts_and_labels(spark):
    lines = [(0, "h0\th1\th2\th3\th4\th5"), (1, "7\t1\t2\tq one\tq two\t1"), (2, "8\t1\t2\tshort"),
             (3, "9\t1\t2\tq3\tq4\t0")]
    df = spark.createDataFrame(lines, "line_no long, line string")
    q = EN.parse_examples(df, "qqp").collect()
    assert [(r.guid, r.text_a, r.text_b, r.label) for r in q] == [
        ("train-7", "q one", "q two", "1"), ("train-9", "q3", "q4", "0")]
    cola = EN.parse_examples(spark.createDataFrame([(0, "src\t1\t\tA sentence")], "line_no long, line string"),
                             "cola").collect()
    assert cola[0].guid == "train-0" and cola[0].label == "1" and cola[0].text_b is None
    lab = spark.createDataFrame([("neutral",), ("entailment",), ("bogus",)], "label string")
    got = [r.label_id for r in EN.map_labels(lab, "mnli").collect()]
    assert got == [2, 1, -1]
    got_rb = [r.label_id for r in EN.map_labels(lab, "mnli", "roberta").collect()]
    assert got_rb == [1, 2, -1]


def test_vocabulary_ids_independent_of_input_order(spark):
    from pyspark.sql import functions as F
    texts = [(i, " ".join(f"w{(i * j) % 13}" for j in range(1, 9))) for i in range(60)]
    df = spark.createDataFrame(texts, "k long, t string")
    a = {r.token: r.token_id for r in EN.build_vocabulary(df, ["t"]).collect()}
    b = {r.token: r.token_id for r in EN.build_vocabulary(df.orderBy(F.rand(3)).repartition(7), ["t"]).collect()}
    assert a == b
    assert sorted(a.values()) == list(range(EN.FIRST_TOKEN_ID, EN.FIRST_TOKEN_ID + len(a)))


def test_cut_lookup_gives_same_encoding(spark):
    ex = spark.createDataFrame(
        [(1, " ".join(f"t{i % 17}" for i in range(300)), "short b"), (2, "a b c", None),
         (3, "x " * 40, " ".join(f"u{i}" for i in range(90)))], "k long, ta string, tb string")
    vocab = EN.build_vocabulary(ex, ["ta", "tb"])
    full = EN.encode(EN.token_ids(ex, "k", ["ta", "tb"], vocab), 32, EN.PRESETS["roberta"], "ids_ta", "ids_tb")
    cut = EN.encode(EN.token_ids(ex, "k", ["ta", "tb"], vocab, max_positions=32), 32, EN.PRESETS["roberta"],
                    "ids_ta", "ids_tb", "len_ta", "len_tb")
    a = {r.k: (r.input_ids, r.segment_ids) for r in full.collect()}
    b = {r.k: (r.input_ids, r.segment_ids) for r in cut.collect()}
    assert a == b
