import os
import tempfile

from pyspark.sql import functions as F

from lectio.operators.align import align_tokens
from lectio.operators.surprisal import token_table
from lectio.sources import read_csv_table, read_json_map, read_raw_lines, read_token_outputs, write_csv_table


def test_token_dir_glob_and_quote(spark):
    d = tempfile.mkdtemp(prefix="lectio-tok-")
    for name, rows in {"12.output-tok": ["a 1 1 2.5", '" 1 2 1.0'], "12.output": ["a 1 1 9.0"],
                       "7.output-tok": ["b 1 1 0.5"]}.items():
        with open(os.path.join(d, name), "w") as f:
            f.write("word wlen sentpos surp\n" + "\n".join(rows) + "\n")
    df = read_token_outputs(spark, d, "word string, wlen long, sentpos long, surp double")
    got = {r.doc_key: r.s for r in df.groupBy("doc_key").agg(F.sum("surp").alias("s")).collect()}
    assert got == {"12": 3.5, "7": 0.5}
    plain = read_token_outputs(spark, d, "word string, wlen long, sentpos long, surp double", glob="*.output")
    assert plain.count() == 1


def test_raw_lines_bom_and_numbers(spark):
    d = tempfile.mkdtemp(prefix="lectio-lines-")
    with open(os.path.join(d, "train.tsv"), "w", encoding="utf-8-sig") as f:
        f.write("h1\th2\nx\t\"y\nz\tw\n")
    got = [(r.line_no, r.line) for r in read_raw_lines(spark, d).orderBy("line_no").collect()]
    assert got == [(0, "h1\th2"), (1, 'x\t"y'), (2, "z\tw")]


def test_json_map_single_object_and_csv_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="lectio-json-")
    with open(os.path.join(d, "m.json"), "w") as f:
        f.write('{"3": 1.5, "20": 2.0}')
    got = {r.k: r.v for r in read_json_map(spark, d, "k", "v", key_type="long").collect()}
    assert got == {3: 1.5, 20: 2.0}
    out = tempfile.mkdtemp(prefix="lectio-csv-") + "/t"
    df = spark.createDataFrame([(1, 'line one\nsaid "hi", ok'), (2, "")], "id long, text string")
    write_csv_table(df, out)
    back = {r.id: r.text for r in read_csv_table(spark, out, "id long, text string").collect()}
    assert back[1] == 'line one\nsaid "hi", ok'


def test_alignment_multi_token_words_and_unk(spark):
    words = spark.createDataFrame([(1, 1, "Don't"), (1, 2, "go,"), (1, 3, "now")], "item long, zone long, word string")
    toks = spark.createDataFrame([(1, 1, "Don't"), (1, 2, "go"), (1, 3, ","), (1, 4, "<unk>")],
                                 "item long, tok_pos long, word string")
    tt = token_table(toks, "item")
    al = {r.zone: r for r in align_tokens(words, tt).collect()}
    assert al[2].pieces == "go," and al[2].n_tok == 2 and al[2].matched == 1
    assert al[2].wlen == 3 and al[2].sentpos == al[2].sentpos_first * 2 + 1
    assert al[3].matched == 1      # <unk> accepted


def test_doc_sums_equal_token_table_sums(spark):
    from lectio.operators import surprisal as S
    docs = spark.createDataFrame([(1, "One two. Three four five! Six"), (2, "..."), (3, ""), (4, "a b? c")],
                                 "doc_id long, text string")
    tt = S.token_surprisal(docs)
    a = {r.doc_id: r for r in tt.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("wlen").alias("w"),
                                                         F.sum("sentpos").alias("s"),
                                                         F.sum("surp").alias("u")).collect()}
    b = {r.doc_id: r for r in S.doc_token_sums(docs).collect()}
    c = {r.doc_id: r.surprisal for r in S.doc_surprisal_sums(docs).collect()}
    for k, r in a.items():
        assert (b[k].n_tokens, b[k].wlen, b[k].sentpos) == (r.n, r.w, r.s)
        assert abs(c[k] - r.u) < 1e-9
    assert b[3].n_tokens == 0 and c[3] == 0.0


def test_strict_alignment_handles_tokenizer_drift(spark):
    from lectio.operators.align import align_tokens, align_tokens_strict
    words = spark.createDataFrame([(1, 1, "I"), (1, 2, "can't"), (1, 3, "go."), (2, 1, "ok")],
                                  "item long, zone long, word string")
    # an external tokenizer split "can't" as "ca" + "n't" (the per-word rule keeps it whole)
    toks = spark.createDataFrame([(1, 1, "I", 1, 1, 1.0), (1, 2, "ca", 2, 2, 2.0), (1, 3, "n't", 3, 3, 3.0),
                                  (1, 4, "go", 2, 4, 4.0), (1, 5, ".", 1, 5, 5.0), (2, 1, "ok", 2, 1, 0.5)],
                                 "item long, tok_pos long, word string, wlen long, sentpos long, surp double")
    closed = {(r.item, r.zone): r for r in align_tokens(words, toks).collect()}
    assert closed[(1, 2)].matched == 0          # drift detected
    strict = {(r.item, r.zone): r for r in align_tokens_strict(words, toks).collect()}
    # sequential rule: "can't" takes len(tokens("can't")) = 1 row ("ca"), then "go." takes 2 rows
    assert strict[(1, 2)].pieces == "ca" and strict[(1, 3)].pieces == "n'tgo"
    assert strict[(2, 1)].matched == 1 and strict[(2, 1)].surp == 0.5


def test_token_table_two_level_sentpos_matches(spark):
    from lectio.operators import surprisal as S
    docs = spark.createDataFrame([(1, "A b. C d e! F g h i j? k l"), (2, "x. y. z")], "doc_id long, text string")
    toks = S.explode_tokens(docs)
    a = {(r.doc_id, r.tok_pos): r.sentpos for r in S.token_table(toks, "doc_id").collect()}
    b = {(r.doc_id, r.tok_pos): r.sentpos for r in S.token_table(toks, "doc_id", block=3).collect()}
    assert a == b and a[(1, 1)] == 1 and a[(1, 4)] == 1


def test_lines_numbered_over_the_parts_of_a_table(spark, tmp_path):
    df = spark.range(500).selectExpr("concat('line ', id) as value", "id")
    df.repartitionByRange(7, "id").sortWithinPartitions("id").select("value").write.text(str(tmp_path / "t"))
    got = {r.line_no: r.line for r in read_raw_lines(spark, str(tmp_path / "t"), one_table=True).collect()}
    assert got == {i: f"line {i}" for i in range(500)}


def test_article_sums_in_one_pass(spark):
    from lectio.operators import surprisal as S
    docs = spark.createDataFrame([(1, "A b. C d e! F"), (2, ""), (3, "x. y, x x"), (4, None)], "doc_id long, text string")
    a = {r.doc_id: r for r in S.doc_token_sums(docs).collect()}
    s = {r.doc_id: r.surprisal for r in S.doc_surprisal_sums(docs).collect()}
    got = {r.doc_id: r for r in S.doc_sums(docs).collect()}
    assert got.keys() == {1, 2, 3, 4}
    for i in (1, 2, 3):
        assert (got[i].n_tokens, got[i].wlen, got[i].sentpos) == (a[i].n_tokens, a[i].wlen, a[i].sentpos) and abs(got[i].surp - s[i]) < 1e-9
    assert got[4].n_tokens == 0 and got[4].surp == 0.0
