"""License scans, HTML text, chat formatting and nearest neighbours."""

import hashlib
import json
import random
import re
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectio.llm import chat, html_text, licenses, neighbours, queries

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- license scans

def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    hits = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def license_docs(spark):
    mit = licenses.TEMPLATES[0][0].split()
    rows = [(1, None), (2, ""), (3, "MIT License, mit license; the MİT License and Kelvin K"), (4, "GNU General\nPublic License. Apache-License / CC BY 4.0 cc by"),
            (5, "x " * 30_000 + "mit license"), (6, "gnu general license"), (7, " ".join(mit[:8] + ["truly"] + mit[8:])), (8, "CC-BY-NC 4.0"),
            (9, "mit license"), (9, "mit license"), (None, "apache license"), (10, "é mit Ωlicense license mit"), (11, " ".join(mit[::-1]))]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1))


def test_license_base_against_plain(spark):
    docs = license_docs(spark).drop("score").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    got = [tuple(r)[:6] for r in licenses.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()]
    want = [(r["doc_id"], *plain_base(r["text"])) for r in docs.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_license_labels_and_score(spark):
    out = {r["doc_id"]: r for r in licenses.scan(license_docs(spark)).collect()}
    assert out[7]["labels"] == "mit" and out[7]["base_labels"] == "" and 0.75 <= out[7]["score"] < 1      # one word put in
    assert out[8]["labels"] == "cc-by,cc-by-nc" and out[8]["base_labels"] == "cc-by"
    assert out[11]["labels"] == "" and out[11]["score"] == 0 and out[1]["labels"] == ""
    for r in out.values():
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert licenses.scan(license_docs(spark).limit(0)).count() == 0


def test_license_scan_is_native(spark):
    plan = licenses.scan(license_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- HTML text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><a href="/">Site</a></header>
<nav><ul><li>Home</li><li>About</li></ul></nav>{top}<div class="content"><h2>Title {i}</h2><p>First <b>para</b>graph &amp; {i}</p>
<p>unclosed {i}<br>line<p>Second&nbsp;  one {i} &lt;tag&gt;</p><div class="share">Share this page</div><ul><li>point {i}<li>next {i}</ul>
<script>var x = "<p>no</p>";</script></div><div id="comments"><p>A reader says {i}</p></div><form><label>Mail</label><input></form>
<div class="cookie-notice">We use cookies</div><footer>Foot {i}</footer></body></html>"""


def site(n):
    return [PAGE.format(i=f"x{i * 7919}", top=f'<div class="ad">Buy {i}</div>' if i % 2 else "") for i in range(n)]


def expected(i):
    x = f"x{i * 7919}"
    return f"Title {x}\nFirst paragraph & {x}\nunclosed {x} line\nSecond one {x} <tag>\npoint {x}\nnext {x}"


def test_wrapper_extraction(spark):
    rows = [(i, f"http://a.example.com/{i}", p) for i, p in enumerate(site(8))]
    rows += [(100, "http://b.example.com/1", None), (101, None, ""), (102, "not a url", "just text &amp; more"), (103, "http://a.example.com/odd", "<p>a<p>b"),
             (104, "http://a.example.com/long", "<article>" + "<p>word </p>" * 20_000), (0, "http://a.example.com/0", site(1)[0])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(1))
    out = html_text.extract(pages).collect()
    assert len(out) == len(rows)
    got = {r["page_id"]: r["text"] for r in out}
    assert all(got[i] == expected(i) for i in range(8))
    assert got[100] == "" and got[101] == "" and got[102] == "just text & more" and got[103] == "a\nb"
    assert got[104] == "\n".join(["word"] * 20_000) and all(r["n_chars"] == len(r["text"]) for r in out)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_wrapper_is_a_union_free_expression():
    w = reduce(html_text._joined, [html_text.wrapper_of(html_text.parse(p)) for p in site(6)])
    text = html_text.expression(w)
    assert "(<div.ad>#TEXT</div>)?" in text and "(<li>#TEXT</li>)+" in text and "'Share this page'" in text and "<h2>#TEXT</h2>" in text
    assert html_text.rule_of(w) == {"path": ["html", "body", "div.content"], "fixed": ["div.share\tShare this page"]}


def test_pages_against_plain_reading(spark):
    import html
    out = {r["page_id"]: r["text"] for r in queries.op8_html_text(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", p.replace("<br>", "\n"))).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert out[r["page_id"]] == "\n".join(filter(None, parts))


def test_article_keeps_what_stands_beside_its_fullest_group():
    def texts(page, n=4):
        pages = [page.replace("#", f"{i} " + "word " * (i + 5)) for i in range(n)]
        rule = html_text.rule_of(reduce(html_text._joined, [html_text.wrapper_of(html_text.parse(p)) for p in pages]))
        return html_text.article(pages[1], rule).replace("1 " + " ".join(["word"] * 6), "#").split("\n")
    assert texts("<body><nav>no</nav><article><h1>T #</h1><p>lead #</p><div class='post-content'><p>a #</p><p>b #</p></div></article><footer>no #</footer></body>") == ["T #", "lead #", "a #", "b #"]
    assert texts("<body><main><article class='x'><p>a # # #</p></article><article class='y'><p>b # #</p></article></main></body>") == ["a # # #", "b # #"]
    assert texts("<body><article class='x'><p>a #</p></article><p>between #</p><article class='y'><p>b #</p></article></body>") == ["a #", "between #", "b #"]
    assert texts("<body><h1>T #</h1><div><p>a # # # # # # # # # # # # #</p></div><div class='ad'>no #</div></body>") == ["T #", "a # # # # # # # # # # # # #"]
    assert texts("<body><div class='post'><h1>T #</h1><div class='entry-content'><p>a #</p></div></div><aside>no #</aside></body>") == ["T #", "a #"]


def test_head_without_end_tag():
    for head in ("<head><title>x</title>", "<HEAD lang=en><meta charset=utf-8><title>x</title><style>p{}</style><script>var a;</script>", "<head><title>x</title></head>"):
        for body in ("<body>", ""):
            assert html_text.article(f"<html>{head}{body}<header>no</header><article><p>Main text</p></article></html>", None) == "Main text"


def test_repeated_heading_and_lead_are_article_text(spark):
    page = "<html><body><nav>Home</nav><article><h1>Same title</h1><p>Same lead.</p><p>Text {}</p><div class='share'>Share</div></article></body></html>"
    pages = spark.createDataFrame([(i, f"http://a.example.com/{i}", page.format(f"x{i}")) for i in range(5)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()} == {i: f"Same title\nSame lead.\nText x{i}" for i in range(5)}


def test_deep_pages_do_not_fail(spark):
    deep = lambda n, inner: "<div>" * n + inner + "</div>" * n
    mixed = "".join(f"<div class='c{chr(97 + i % 7)}'><span>t{i}</span>" for i in range(3000))
    pages = [deep(600, "<p>one</p><p>two</p>"), deep(5000, "<p>one</p><aside>no</aside><p>two</p>"), mixed,
             "<article>" + "<section>x" * 2000, "<div><div class='ad'>" + deep(400, "no") + "</div><p>yes</p></div>",
             "<ul><li>" * 3000 + "end"]
    rows = [(i, f"http://h{i % 2}.example.com/", p) for i, p in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == got[1] == "one\ntwo" and got[2] == "\n".join(f"t{i}" for i in range(3000))
    assert got[3] == "\n".join(["x"] * 2000) and got[4] == "yes" and got[5] == "end"


def test_markup_that_swallowed_text():
    for page, want in (('<article><svg class="icon"/><p>Main</p></article>', "Main"), ("<article><svg><p>Main</p></article>", "Main"),
                       ("<title>T<p>Main</p>", "Main"), ('<a title="a>b" href="x">Main</a>', "Main"), ("<p title='it\"s > x'>Main</p>", "Main"),
                       ("<svg><text>no</text></svg><p>Main", "Main"), ("<p>Main</p><script>var a = '<p>no</p>'", "Main"), ("<p>a < b <br/> c", "a < b c"),
                       ("<script src='x'/>no</script><p>Main", "Main"), ("</svg><p>Main", "Main"), ("<p " + "x='" * 3 + ">Main", "Main")):
        assert html_text.article(page, None) == want, page


def test_article_blocks_with_names_like_asides():
    page = ("<article><h1>T</h1><div class='side-by-side'><p>one</p></div><p class='market-share'>two</p><section class='social'><p>three</p></section>"
            "<div class='share-buttons'>no</div><div class='cookie-notice'>no</div><div id='comments'>no</div><div class='ad ad-top'>no</div><p>four</p></article>")
    assert html_text.article(page, None) == "T\none\ntwo\nthree\nfour"
    assert html_text.article("<body><nav>no</nav><p>Lead</p><article><p>Text</p></article><div class='sidebar'>no</div></body>", None) == "Lead\nText"


def test_the_wrapper_takes_out_a_menu_without_a_telling_name(spark):
    page = "<html><body><div>Home About Contact</div><div><p>Same rubric</p><h2>Head {i}</h2><p>Text {i}</p>{more}</div><div>Imprint</div></body></html>"
    rows = [(i, "http://a.example.com/", page.format(i=i, more=f"<p>More {i}</p>" * (i % 3))) for i in range(9)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, p in rows:
        assert got[i].endswith("\n".join([f"Head {i}", f"Text {i}"] + [f"More {i}"] * (i % 3))) and "Home" not in got[i] and "Imprint" not in got[i]
        assert "Home About Contact" in html_text.article(p, None)


def test_many_differing_siblings_align_quickly():
    import time
    def page(k):
        return "<body>" + "".join(f"<div class='n{'abcdefghij'[(i * k) % 10]}{'xyz'[(i // 10) % 3]}'>t{i}</div>" for i in range(3000)) + "</body>"
    a, b = (html_text.wrapper_of(html_text.parse(page(k))) for k in (1, 3))
    start = time.time()
    w = html_text._joined(a, b)
    assert time.time() - start < 1 and w["n"] == 2
    once = ["<body>" + "".join(f"<div class='{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}'>t</div>" for i in range(3000) if i % 3 != k) + "</body>" for k in (0, 1)]
    a, b = (html_text.wrapper_of(html_text.parse(p)) for p in once)
    start = time.time()
    body = html_text._joined(a, b)["c"][0]["c"]
    assert time.time() - start < 1 and sum(not x["o"] for x in body) == 1000 and len(body) == 3000


# ---- chat formatting

HARD = ["", "\\", "<|end|>", "\\l\\b<", "<|assistant|>\\", "a\n<|end|>\n\\b", "\\\\<<", "né😀", "|>", "<|user|>x|>"]


def test_chat_round_trip(spark):
    rng = random.Random(1)
    convs = [[(rng.choice(["user", "assistant", "system", "odd|>role<\\"]), "".join(rng.choices(HARD, k=rng.randint(0, 4)))) for _ in range(rng.randint(1, 6))] for _ in range(60)]
    rows = [(i, t, r, x) for i, c in enumerate(convs) for t, (r, x) in enumerate(c)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.read_back(chat.format_turns(chat.canonical(chat.turn_records(df)))).collect()
    for r in out:
        want = convs[r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["read"]] == want
        assert r["loss_text"] == "".join(x for role, x in want if role == "assistant")


def test_chat_layouts(spark):
    same = [("user", "q"), ("assistant", "a")]
    records = [({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 5}, same),
               ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, same), ({"prompt": "q", "response": "a"}, same),
               ({"system": "s", "prompt": "q", "response": "a"}, [("system", "s"), *same]), ({"instruction": "q", "output": "a"}, same),
               ({"instruction": "q", "input": "i", "output": "a"}, [("user", "q\n\ni"), ("assistant", "a")]), ({"question": "q", "answer": "a"}, same),
               ({"data": {"question": "q", "answer": "a"}}, same), ({"prompt": None, "response": "a"}, [("user", ""), ("assistant", "a")])]
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(records)] + [(90, None), (91, "not json {"), (92, '{"other": 1}'), (93, "[]"), (0, rowed := json.dumps(records[0][0]))]
    out = chat.format_turns(chat.canonical(spark.createDataFrame(rows, "turns long, record string").withColumnRenamed("turns", "n"))).collect()
    assert len(out) == len(rows) and rowed
    for r in out:
        if r["n"] < 90:
            assert [(t["role"], t["text"]) for t in r["turns"]] == records[r["n"]][1] and r["layout"]
        else:
            assert r["layout"] is None and r["turns"] is None
    assert len({r["layout"] for r in out if r["n"] in (1, 2, 3, 4, 5, 6, 7)}) == 7


def test_chat_odd_rows(spark):
    df = spark.createDataFrame([(1, 0, None, None), (1, None, "user", "x"), (None, 1, "assistant", "y"), (2, 1, "user", "z"), (2, 1, "user", "z"),
                                (3, 0, "assistant", "long <" * 50_000)], "conv_id long, turn long, role string, text string").withColumn("record", F.lit(3))
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(chat.canonical(chat.turn_records(df)))).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["read"]] == [("user", "x"), ("", "")] and len(out[2]["read"]) == 2 and out[None]["loss_text"] == "y"
    assert out[3]["loss_text"] == "long <" * 50_000
    assert chat.turn_records(df.limit(0)).count() == 0


def test_chat_keeps_texts_over_the_json_limit(spark):
    df = spark.sql("select 1L conv_id, 0L turn, 'user' role, 'q' text union all select 1L, 1L, 'assistant', repeat('ab', 10000001)")
    r = chat.canonical(chat.turn_records(df)).selectExpr("layout", "size(turns) n", "length(turns[1].text) chars").first()
    assert (r["layout"], r["n"], r["chars"]) == ("turn rows", 2, 20_000_002)
    long = spark.sql("select '{\"prompt\": \"q\", \"response\": \"' || repeat('ab', 10000001) || '\"}' record")
    with pytest.raises(Exception, match="does not parse"):
        chat.canonical(long).select("layout").collect()


def test_chat_structs_of_other_layouts(spark):
    same = [("user", "q"), ("assistant", "a")]
    for sql in ("named_struct('messages', array(named_struct('role', 'human', 'content', 'q'), named_struct('role', 'assistant', 'content', 'a')), 'id', 5)",
                "named_struct('data', named_struct('question', 'q', 'answer', 'a'))", "named_struct('prompt', 'q', 'response', 'a')"):
        r = chat.canonical(spark.sql(f"select {sql} record")).first()
        assert [(t["role"], t["text"]) for t in r["turns"]] == same and r["layout"]
    r = chat.canonical(spark.sql("select named_struct('other', 1) record")).first()
    assert r["layout"] is None and r["turns"] is None


def test_chat_query(spark):
    out = {r["conv_id"]: r for r in queries.op9_chat_format(spark, SF).collect()}
    text = "\\### Assistant: </turn> ok"
    assert out[-7]["n_turns"] == 2 and out[-7]["loss_chars"] == len(text) and out[-7]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert out[-7]["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    plan = queries.op9_chat_format(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- nearest neighbours

def plain_nearest(rows, asks, k=20):
    ids, vecs = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for q in asks:
        s = vecs @ vecs[np.flatnonzero(ids == q)[0]]
        out[q] = [(int(ids[a]), float(s[a])) for a in np.lexsort((ids, -s)) if ids[a] != q][:k]
    return out


@pytest.mark.parametrize("block", [neighbours.DATA_BLOCK, 300])
def test_nearest_recall(spark, block, monkeypatch):
    monkeypatch.setattr(neighbours, "DATA_BLOCK", block)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 40)
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = plain_nearest(rows, [i for i, _ in rows if i % 20 == 0])
    got = {}
    for r in queries.op10_collision_search(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(want) and all(sorted(g) == list(range(1, 21)) for g in got.values())
    hits = [len({i for i, _ in got[q].values()} & {i for i, _ in want[q]}) for q in want]
    assert np.mean(hits) / 20 >= 0.9
    for q, g in got.items():
        true = dict(plain_nearest(rows, [q], len(rows))[q])
        assert all(abs(true[i] - s) < 1e-12 for i, s in g.values())
        pairs = [(-s, i) for _, (i, s) in sorted(g.items())]
        assert pairs == sorted(pairs)


@pytest.mark.parametrize("sigma", [0.5, 1.0, 2.0])
def test_nearest_recall_on_unequal_lengths(spark, sigma):
    rng = np.random.default_rng(int(10 * sigma))
    vecs = rng.standard_normal((5000, 32)) / np.sqrt(32) * rng.lognormal(0, sigma, 5000)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)]
    want = plain_nearest(rows, range(0, 5000, 20))
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert all(len(g) == 20 for g in got.values()) and got.keys() == want.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert np.mean(hits) / 20 >= 0.9
    exact = vecs @ vecs.T
    assert all(abs(exact[q, i] - s) <= 1e-12 * max(1, abs(s)) for q, g in got.items() for i, s in g)


def test_nearest_extreme_lengths(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.standard_normal(4) * s).tolist()) for i, s in enumerate([1e-160, 1e-3, 1.0, 1e4, 1e150] * 30)]
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [i for i, _ in x] for q, x in plain_nearest(rows, range(0, 150, 20), 5).items()}


def test_nearest_odd_rows(spark):
    rng = np.random.default_rng(3)
    same = [0.5, 0.5, 0.0]
    rows = [(i, same) for i in range(0, 60)] + [(i, rng.standard_normal(3).tolist()) for i in range(60, 90)]
    bad = [(1000, None), (1020, []), (1040, [0.0, 0.0, 0.0]), (1060, [1.0, None, 1.0]), (1080, [float("nan"), 1.0, 1.0]), (1100, [float("inf"), 1.0, 1.0]), (None, same)]
    df = spark.createDataFrame([*rows, *bad, (0, same)], "vec_id long, embedding array<double>").withColumn("key", F.lit(1))
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = plain_nearest(rows, [i for i, _ in rows if i % 20 == 0])
    assert got == {q: [i for i, _ in x] for q, x in want.items()}
    few = df.where("vec_id in (0, 1, 60)")
    assert {(r["query_id"], r["rank"]) for r in neighbours.nearest(few, F.col("vec_id") % 20 == 0).collect()} == {(0, 1), (0, 2), (60, 1), (60, 2)}
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
