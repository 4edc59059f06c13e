"""Registered queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat
from .common import table
from .decontaminate import find_leaks
from .html_text import extract
from .langid import identify
from .licenses import scan
from .line_dedup import dedup_lines
from .mixing import mix
from .neighbours import nearest
from .prefix_trie import ordered_turns, share_heads, trie
from .resample import resample
from .simhash import near_duplicates
from .suffixes import cut_repeats
from .warc import archive_pages


def op1_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "lang_pred", "score", "bits", "rejected")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped",
        F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = chat.turn_records(table(spark, sf_dir, "conversations"))
    hard = "\\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"),
                                  F.to_json(F.struct(F.lit(hard).alias("prompt"), F.lit(hard).alias("response"))).alias("record"))
    both = chat.canonical(records).drop("record").unionByName(chat.canonical(extra).drop("record"))
    read = chat.read_back(chat.format_turns(both))
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op10_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*share_heads(*ordered_turns(table(spark, sf_dir, "conversations"))))


QUERIES = {f.__name__: f for f in (op1_pareto_mixing, op2_language_id, op3_decontamination, op4_suffix_dedup, op5_line_dedup, op6_license_scan, op7_simhash, op8_html_text,
                                op9_chat_format, op10_collision_search,
                                op11_importance_resample, op12_warc, op13_prefix_trie)}

# Sources' targets by one pass over the sorted saturation levels; the sample by a running sum over the ranks.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::INT] AS w,
              2.0::DOUBLE * source_size AS cap FROM s0),
s2 AS (SELECT *, row_number() OVER (ORDER BY cap / w, source) AS k,
              1.5::DOUBLE * sum(source_size) OVER () AS total,
              coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
              sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s1),
lv AS (SELECT min_by((total - capped) / rest, k) AS level FROM s2 WHERE (total - capped) / rest * w < cap),
t AS (SELECT source, source_size, CASE WHEN level IS NULL OR w * level >= cap THEN cap ELSE w * level END AS target FROM s2, lv),
e AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, target / source_size) ELSE 0 END AS e
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, floor(e)::BIGINT AS whole, e - floor(e) AS pi FROM e),
g AS (SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS words_left,
             avg(CASE WHEN pi > 0 THEN pi END) OVER (PARTITION BY source) AS mean FROM f),
h AS (SELECT *, CASE WHEN pi > 0 AND size > 0 THEN (u / (1 - u)) * ((1 - pi) / pi) * (mean / (1 - mean)) END AS odds FROM g),
r AS (SELECT *, odds / (1 + odds) AS rank FROM h),
c AS (SELECT *, rank IS NOT NULL AND sum(CASE WHEN rank IS NULL THEN 0 ELSE size END) OVER (
             PARTITION BY source ORDER BY rank NULLS LAST, size, doc_id ROWS UNBOUNDED PRECEDING) <= words_left AS extra FROM r),
m AS (SELECT *, words_left - sum(CASE WHEN extra THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM c),
n AS (SELECT *, CASE WHEN NOT extra AND rank IS NOT NULL AND abs(gap - size) < abs(gap) THEN
             row_number() OVER (PARTITION BY source, (NOT extra AND rank IS NOT NULL AND abs(gap - size) < abs(gap))
                                ORDER BY abs(gap - size), rank, doc_id) END AS near FROM m)
SELECT doc_id, size, source_size, target, (whole + extra::INT + coalesce(near = 1, false)::INT) * size AS taken,
       (whole + extra::INT + coalesce(near = 1, false)::INT)::BIGINT AS copies
FROM n"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
l AS (SELECT row, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT row) >= 5),
j AS (SELECT k.*, c.top IS NOT NULL AND (k.doc_id IS NULL OR k.doc_id < c.top) AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY row, doc_id"""

OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
             length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '|', '\p')) AS role_chars,
             length(replace(replace(text, '\', '\b'), '<', '\l')) AS text_chars FROM c),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS said,
             coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss,
             sum(role_chars + text_chars + 11)::BIGINT AS formatted_chars
      FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a"""

# CRC-32 by its bits, one byte of the text after another; ``{x}`` is the text.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT],
    list_transform(range(1, length(hex(encode({x})))::BIGINT, 2), lambda i: ('0x' || substr(hex(encode({x})), i, 2))::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END)), 4294967295::BIGINT)"""

OP11_SQL = r"""
WITH x AS (
  SELECT row_number() OVER () AS row, doc_id, FALSE AS goal, text FROM documents
  UNION ALL SELECT NULL, NULL, TRUE, text FROM benchmark),
w AS (SELECT row, doc_id, goal, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[0-9a-z\x{80}-\x{10FFFF}]+') AS words FROM x),
f AS (SELECT row, goal, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature FROM w),
g AS (SELECT feature, row, goal, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT feature, """ + _CRC.format(x="feature") + r""" % 10000 AS bucket FROM (SELECT DISTINCT feature FROM g)),
h AS (SELECT row, goal, bucket, sum(n)::BIGINT AS n FROM g JOIN b USING (feature) GROUP BY ALL),
k AS (SELECT bucket, coalesce(sum(n) FILTER (NOT goal), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (goal), 0)::DOUBLE AS t FROM h GROUP BY bucket),
z AS (SELECT coalesce(sum(n) FILTER (NOT goal), 0)::DOUBLE AS all_s, coalesce(sum(n) FILTER (goal), 0)::DOUBLE AS all_t FROM h),
v AS (SELECT bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain FROM k, z),
d AS (SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM h JOIN v USING (bucket) WHERE NOT goal GROUP BY row),
e AS (SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features,
             coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
             ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS hash
      FROM w LEFT JOIN d USING (row) WHERE NOT goal),
r AS (SELECT *, weight + floor(-1000 * ln(-ln((hash + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM e),
o AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) END AS place,
             (25 * count(*) FILTER (n_words >= 20) OVER ()) // 100 AS drawn FROM r)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score::BIGINT AS score, CASE WHEN place <= drawn THEN place END AS rank FROM o"""

OP12_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS k,
                  min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least FROM pages)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN k > 1 AND strlen(html) >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k > 1 AND strlen(html) >= 100 THEN least END AS refers_to
FROM p"""

# A prefix is named by the list of its turns; subtree sums meet every node with its ancestors.
OP13_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS said,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                                     sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, """ + _CRC.format(x="conv_id::VARCHAR") + r""" % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
lent AS (SELECT c.conv_id, count(t.pos) AS taken FROM c LEFT JOIN t ON t.conv_id = c.base AND t.pos < c.h GROUP BY c.conv_id),
r AS (SELECT c.conv_id, t.pos, role, said FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h
      UNION ALL SELECT c.conv_id, t.pos - c.h + lent.taken, role, said FROM c JOIN lent USING (conv_id) JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h),
s AS (SELECT conv_id, pos + 1 AS depth, strlen(said) AS bytes,
             list({'role': role, 'said': said}) OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM r
      UNION ALL SELECT conv_id, 0, 0, [] FROM c),
n AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM s GROUP BY depth, prefix),
path AS (SELECT s.conv_id, s.depth, n.conv_id AS node, n_convs, bytes, lag(n.conv_id) OVER (PARTITION BY s.conv_id ORDER BY s.depth) AS up,
                max(s.depth) OVER (PARTITION BY s.conv_id) AS len
         FROM s JOIN (SELECT * RENAME (bytes AS node_bytes) FROM n) n ON s.depth = n.depth AND s.prefix = n.prefix),
node AS (SELECT conv_id, depth, up, n_convs, bytes FROM path WHERE conv_id = node),
kids AS (SELECT up AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
own AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (conv_id, depth)),
sums AS (SELECT p.node AS conv_id, p.depth, count(*) FILTER (o.n_children = 0) AS n_leaves, sum((o.n_convs - 1) * o.bytes)::BIGINT AS saved
         FROM own o JOIN path p ON p.conv_id = o.conv_id AND p.depth <= o.depth GROUP BY ALL),
ends AS (SELECT node AS conv_id, depth, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM path WHERE depth = len GROUP BY ALL)
SELECT o.conv_id, o.depth::BIGINT AS depth, o.up AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved AS saved_tokens,
       sha256(coalesce(e.ids, '')) AS ends_sha256
FROM own o JOIN sums s USING (conv_id, depth) LEFT JOIN ends e USING (conv_id, depth)"""

SQL: dict[str, str] = {"op9_chat_format": OP9_SQL, "op1_pareto_mixing": OP1_SQL, "op5_line_dedup": OP5_SQL,
                       "op11_importance_resample": OP11_SQL, "op12_warc": OP12_SQL, "op13_prefix_trie": OP13_SQL}
