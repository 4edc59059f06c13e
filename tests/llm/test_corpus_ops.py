"""Source mixing, language ID, decontamination, line dedup, SimHash and the pipeline."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectio.llm import decontaminate as dc
from lectio.llm import langid, line_dedup, mixing, queries, simhash
from lectio.llm.components import connected_components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"


def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    line = "A line that is repeated in many documents, with Ä and more."
    rows = [(1, None, "en", "a", None, 1), (2, "", "en", "a", 0, 2), (3, "x " * 30_000, "en", "b", None, 3),
            (4, "12 34 ! ?", None, None, 1, None), (None, "no id here\n" + line, "en", "b", 1, 1), (5, "same text", "en", "b", 1, 1),
            (5, "same text", "en", "b", 1, 1), (5, "other text with the same id", "de", None, 1, 1)]
    rows += [(i, f"document {i}\n  {line.upper() if i % 2 else line}\t\n{line}", "en", "c", 1, 1) for i in range(10, 17)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- mixing

def test_mix_targets_and_caps(spark):
    out = queries.op1_pareto_mixing(spark, SF).toPandas()
    assert (out["taken"] <= 2 * out["size"]).all()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").toPandas()
    per = out.merge(docs, on="doc_id").groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"), largest=("size", "max"))
    assert math.isclose(per["target"].sum(), 1.5 * per["size"].sum(), rel_tol=1e-9)
    assert (abs(per["taken"] - per["target"]) <= per["largest"] / 2 + 1).all()
    again = queries.op1_pareto_mixing(spark, SF).toPandas()
    assert sorted(map(tuple, again.to_numpy().tolist())) == sorted(map(tuple, out.to_numpy().tolist()))


def test_mix_unequal_rates(spark):
    n = 4000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', 10)").alias("text"), F.lit("s").alias("source"))
    rate = F.when(F.col("doc_id") % 2 == 0, F.lit(3.0)).otherwise(F.lit(1.0))
    out = mixing.mix(docs, share=0.5, rate=rate).toPandas()
    assert abs(out["taken"].sum() - 0.5 * 10 * n) <= 10
    even, odd = out[out.doc_id % 2 == 0]["copies"].mean(), out[out.doc_id % 2 == 1]["copies"].mean()
    assert abs(even - 0.75) < 0.03 and abs(odd - 0.25) < 0.03      # expected copies 3:1 with mean one half
    out = mixing.mix(docs, share=1.8, rate=rate).toPandas()          # the higher rate stops at two copies
    assert (out[out.doc_id % 2 == 0]["copies"] == 2).all() and abs(out["copies"].mean() - 1.8) < 0.01


def test_mix_odd_rows(spark):
    out = mixing.mix(odd_docs(spark)).toPandas()
    assert len(out) == 15 and out[out.doc_id == 1]["size"].tolist() == [0] and (out["taken"] <= 2 * out["size"]).all()
    assert mixing.mix(empty(spark)).count() == 0


# ---- language ID

def plain_kneser_ney(text_counts, order):
    """Interpolated Kneser-Ney straight from its definition, with dictionaries."""
    levels = {order: Counter(text_counts)}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[-k:] for g in levels[k + 1])
    cut = {}
    for k, c in levels.items():
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        cut[k] = ones / (ones + 2 * twos) if ones and twos else 0.5
    alphabet = len(levels[1]) + 1

    def p(g):
        k = len(g)
        c = levels[k]
        if k == 1:
            total = sum(c.values())
            return max(c[g] - cut[1], 0) / total + cut[1] * len(c) / total / alphabet
        own = {x: v for x, v in c.items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        total = sum(own.values())
        return max(c[g] - cut[k], 0) / total + cut[k] * len(own) / total * p(g[1:])
    return p


def test_kneser_ney_against_definition():
    text = b"the cat sat on the mat. The dog ate the cat's hat!"
    chars, n = langid.letters([text])
    grams = langid.packed(chars, 4)[langid._inside(n, 4)[0]]
    g, c = np.unique(grams, return_counts=True)
    model = langid.KneserNey.fit(["x"], [g], [c])
    name = lambda v: "".join(chr(int(v) >> s & 0xFFFF) for s in (48, 32, 16, 0))
    p = plain_kneser_ney({name(v): int(k) for v, k in zip(g, c)}, 4)
    probe = langid.packed(langid.letters([b"the mat at hat dog cat on the"])[0], 4)
    got = model.scores(probe)[:, 0]
    want = [math.log2(p(name(v))) for v in probe]
    assert np.allclose(got, want, atol=1e-4)


def test_letters_normalisation():
    chars, n = langid.letters(["Ab1!É".encode(), None, b"", "𐐀x".encode()])
    assert "".join(chr(c) for c in chars[:n[0]]) == " ab é " and list(n[1:3]) == [1, 1] and n[3] == 4


def test_language_held_out_accuracy(spark):
    out = queries.op2_language_id(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    held = out.merge(docs, on="doc_id")
    held = held[held["held_out"] & held["lang"].notna()]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97
    assert out["score"].between(0, 1).all() and out["rejected"].mean() < 0.02


def test_language_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    both = docs.withColumn("extra", F.lit(1)).unionByName(odd_docs(spark))
    out = langid.identify(both).toPandas()
    assert len(out) == docs.count() + 15
    alone = langid.identify(odd_docs(spark)).toPandas()
    und = alone[alone["lang_pred"] == "und"]
    assert {1, 2, 4} <= set(und["doc_id"].dropna()) and (und["score"] == 0).all() and und["rejected"].all()
    assert langid.identify(empty(spark)).count() == 0


def test_language_rejects_foreign_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10**9, "χψω ωψχ ξζφ " * 40, None), (10**9 + 1, "qzxv jkwq xxzj vvkq " * 30, None)], docs.schema)
    out = langid.identify(docs.unionByName(odd)).where("doc_id >= 1000000000").toPandas()
    assert out["rejected"].all()


def test_language_model_keeps_all_grams(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").where("lang is not null")
    docs = docs.unionByName(spark.createDataFrame([(10**9, "Ωmega ψalter ξeno φloem and the rare one", "rare")], docs.schema))
    whole, shards = langid.fit(docs), langid.fit(docs, max_grams=2_000)
    assert len(whole.shards) == 1 and len(shards.shards) > 3 and "rare" in shards.langs
    a, b = (langid.predict(docs, m).toPandas().sort_values("doc_id") for m in (whole, shards))
    assert a["lang_pred"].tolist() == b["lang_pred"].tolist() and np.allclose(a["bits"], b["bits"], atol=1e-5)
    assert b[b["doc_id"] == 10**9]["lang_pred"].tolist() == ["rare"]


# ---- decontamination

def edited(words, rng, share):
    out = []
    for w in words:
        r = rng.random()
        if r < share / 3:
            continue
        out.append("changed" if r < 2 * share / 3 else w)
        if r > 1 - share / 3:
            out.append("added")
    return out


def test_leaks_found_and_clean_kept(spark):
    rng = random.Random(3)
    vocabulary = ["w%d" % (3000 ** rng.random()) for _ in range(4000)]      # word frequencies fall as 1/rank
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(15, 60))) for i in range(30)]
    rows, planted = [], set()
    for d in range(300):
        body = text(rng.randint(5, 400))
        if d % 5 == 0:
            i = rng.randrange(30)
            copy = edited(items[i][1].split(), rng, 0.15 if d % 10 == 0 else 0.0)
            body = body + " " + ", ".join(copy).upper() + " " + text(20)
            planted.add((d, i))
        rows.append((d, body))
    rows += [(1000, None), (1001, ""), (1002, "w1 " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (98, None), (99, "short")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs, bench).collect()}
    assert found == planted
    kept = dc.decontaminate(docs, bench)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in planted}
    assert dc.find_leaks(docs.limit(0), bench).count() == 0 and dc.find_leaks(docs, bench.limit(0)).count() == 0
    assert dc.decontaminate(docs, bench.withColumn("item_id", F.lit(None).cast("string"))).count() == kept.count()


def test_short_items_and_scripts_without_spaces(spark):
    bench = spark.createDataFrame([(0, "Capital of France?"), (1, "氷"), (2, "日本の首都は東京であり、人口は約千四百万人です。"), (3, "เมืองหลวงของประเทศไทยคือกรุงเทพ"), (4, "?!"), (5, "to be"), (5, "to be")],
                                  "item_id long, text string")
    docs = spark.createDataFrame([(0, "what is the capital, of FRANCE and"), (1, "capital of the france"), (2, "彼は言った。日本の首都は大阪であり人口は約千四百万人です。はい"), (3, "ก่อน เมืองหลวงของประเทศไทยคือกรุงเทพ"),
                                  (4, "こおり氷だ"), (5, "or not TO be"), (6, "tobe be to"), (7, "?!"), (8, None)], "doc_id long, text string")
    found = sorted((r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs, bench).collect())
    assert found == [(0, 0), (2, 2), (3, 3), (4, 1), (5, 5), (5, 5)]


def test_every_copy_above_the_score_is_found(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    items = [rng.sample(words, m) for m in [8, 9, 12, 16, 16, 24, 40] * 12]
    docs = []
    for i, x in enumerate(items):
        other = lambda: f"z{rng.randrange(10**6)}"
        copies = [[other() if p % 3 == 2 else w for p, w in enumerate(x)],                      # every third word changed
                  [other() if rng.random() < 0.25 else w for w in x],
                  [v for w in x for v in (w, other())],                                         # a word put in after each
                  [w for p, w in enumerate(x) if p % 4 != 1]]
        docs += [(len(docs) + k, i, [other() for _ in range(20)] + c + rng.sample(words, 20)) for k, c in enumerate(copies)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(spark.createDataFrame([(d, " ".join(x)) for d, _, x in docs], "doc_id long, text string"), bench).collect()}
    number = {}
    for d, i, x in docs:
        a, b = (np.array([number.setdefault(w, len(number) + 1) for w in y]) for y in (items[i], x))
        if dc.smith_waterman([a], [b])[0][0] >= len(a):
            assert (d, i) in found, (d, i, len(a))


def test_smith_waterman_against_plain_matrix():
    rng = random.Random(5)
    pairs = [([rng.randint(1, 4) for _ in range(rng.randint(3, 12))], [rng.randint(0, 4) for _ in range(rng.randint(3, 15))]) for _ in range(60)]

    def plain(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        return h.max()
    got, _ = dc.smith_waterman([np.array(a) for a, _ in pairs], [np.array(b) for _, b in pairs])
    assert got.tolist() == [plain(a, b) for a, b in pairs]


# ---- line dedup

def plain_line_dedup(rows, min_chars=40, min_docs=5):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    held = defaultdict(list)
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                held[k].append(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for x in lines:
            h = held.get(key(x), [])
            top = max((y for y in h if y is not None), default=None)
            if len(h) < min_docs or top is None or d == top:
                kept.append(x)
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("which", ["odd", "table"])
def test_line_dedup_against_plain(spark, which):
    docs = odd_docs(spark) if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    out = line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256))
    assert sorted(map(tuple, out.collect()), key=str) == plain_line_dedup([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_line_index_is_reversible(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    part, rest = docs.where("doc_id % 3 > 0"), docs.where("doc_id % 3 = 0")
    state = lambda x: ({(bytes(r["key"]), r["n"], r["top"]) for r in x.counts.collect()},
                       {(r["doc_id"], tuple(map(bytes, r["keys"]))) for r in x.postings.collect()})
    one = line_dedup.build_index(part)
    both = line_dedup.insert(one, rest)
    assert state(both) == state(line_dedup.build_index(docs))
    back = line_dedup.delete(both, rest)
    assert state(back) == state(one)
    result = lambda d, x=None: sorted(map(str, line_dedup.dedup_lines(d, x).collect()))
    assert result(docs, both) == result(docs) and result(part, back) == result(part)
    hot = {bytes(r["key"]) for r in back.counts.where("n >= 5").collect()}
    probe = line_dedup.Probe([(r["shard"], bytes(r["cells"])) for r in back.filters.collect()], back.shards)
    known = np.frombuffer(b"".join(sorted(hot)), "<u8").reshape(-1, 2)
    assert probe.maybe(known).all()
    strange = np.random.default_rng(1).integers(0, 2**63, (20_000, 2)).astype("<u8")
    assert probe.maybe(strange).mean() < 0.01


def test_cuckoo_filter_add_and_remove():
    rng = np.random.default_rng(2)
    keys = [rng.bytes(16) for _ in range(5000)]
    f = line_dedup._filled(keys)
    for k in keys[:2500]:
        f.remove(k)
    for k in keys[2500:]:
        mark, one, two = f._places(k)
        assert (f.cells[one] == mark).any() or (f.cells[two] == mark).any()
    for k in keys[2500:]:
        f.remove(k)
    assert not f.cells.any()


# ---- SimHash

def plain_fingerprint(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
    if not w:
        return 0
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, max_bits=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= max_bits:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_against_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(5000, None), (5001, ""), (5002, " \n"), (5003, "One two"), (5004, "ONE two")], docs.schema))
    rows = docs.collect()
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    fps = [plain_fingerprint(r["text"]) for r in rows]
    comp = plain_components(fps)
    low = defaultdict(lambda: 10**9)
    for r, c in zip(rows, comp):
        low[c] = min(low[c], r["doc_id"])
    assert got == {r["doc_id"]: (f, low[c]) for r, f, c in zip(rows, fps, comp)}


@pytest.mark.parametrize("heavy", [simhash.HEAVY_TRIE, 8])
def test_trie_join_against_all_pairs(spark, heavy, monkeypatch):
    monkeypatch.setattr(simhash, "HEAVY_TRIE", heavy)
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    near = []
    for b in base:
        for _ in range(rng.integers(0, 12)):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            near.append(x)
    fps = sorted({*map(int, base), *near, 0, 1, 2**64 - 1})
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    root = {r["node"] % 2**64: r["root"] for r in connected_components(simhash.linked(df)).collect()}
    comp = plain_components(fps)
    size = Counter(comp)
    want = {f: c for f, c in zip(fps, comp) if size[c] > 1}
    assert set(root) == set(want)
    pairs = {}
    for f, c in want.items():
        assert pairs.setdefault(c, root[f]) == root[f]
    assert len(set(pairs.values())) == len(pairs)


def test_simhash_odd_rows(spark):
    out = simhash.near_duplicates(odd_docs(spark)).toPandas()
    assert len(out) == 15 and out[out.doc_id.isin([1, 2])]["component_id"].nunique() == 1
    assert simhash.near_duplicates(empty(spark)).count() == 0


# ---- pipeline

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "source_mixing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != "source_mixing":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
    assert seen["language_id"].count() >= 0.98 * spark.read.parquet(f"{SF}/documents.parquet").count()
    fps = [r["fp"] % 2**64 for r in simhash.fingerprints(seen["simhash_near_dedup"]).collect()]
    assert len(set(plain_components(fps))) == len(fps)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert dc.find_leaks(seen["decontamination"], bench).count() == 0
    ids = {r["doc_id"] for r in seen["simhash_near_dedup"].collect()}
    leaky = {r["doc_id"] for r in dc.find_leaks(seen["simhash_near_dedup"], bench).collect()}
    assert {r["doc_id"] for r in seen["decontamination"].collect()} == ids - leaky


def test_pipeline_odd_rows(spark):
    import corpus_pipeline
    clash = odd_docs(spark).withColumns({c: F.lit(7) for c in ("rejected", "score", "n_lines", "row", "doc", "copies", "_rid", "held_out")})
    for docs in (clash, clash.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            n = out.count()
            assert n <= docs.count()
            if name != "source_mixing":
                assert out.columns == docs.columns
