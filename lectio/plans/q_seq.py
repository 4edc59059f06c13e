"""Registered queries: sequence-task examples, labels and encoding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import encode as EN
from . import fixtures as X
from .oracle_views import TOK, task_lines_sql, with_views
from .registry import _t, query

MAX_LEN = 64


def _sql_field(idx):
    if idx is None:
        return "CAST(NULL AS VARCHAR)"
    return "f[-1]" if idx == -1 else f"f[{idx + 1}]"


def _parse_sql(set_type: str = "train") -> str:
    parts = []
    for task, lay in EN.LAYOUTS.items():
        guid = "CAST(line_no AS VARCHAR)" if lay["guid"] == "row" else _sql_field(lay["guid"])
        where = ["line_no > 0"] if lay["header"] else ["TRUE"]
        if lay["min_fields"]:
            where.append(f"len(f) >= {lay['min_fields']}")
        parts.append(f"""SELECT '{task}' AS task, line_no, '{set_type}-' || {guid} AS guid,
            {_sql_field(lay['a'])} AS text_a, {_sql_field(lay['b'])} AS text_b, {_sql_field(lay['label'])} AS label
          FROM (SELECT line_no, string_split(line, chr(9)) AS f FROM lines WHERE task = '{task}')
          WHERE {' AND '.join(where)}""")
    return "\nUNION ALL\n".join(parts)


def _parsed(spark, sf):
    """Write the ten task tables in ordered range parts (no task holds a whole table), read them
    back as raw lines (S4) and parse each with its layout (E1)."""
    from ..session import scratch_path
    from ..sources import read_raw_lines
    t = _t(spark, sf)
    path = scratch_path(spark, "task-tsv")
    lines = X.all_task_lines(t)
    (lines.repartitionByRange("task", "line_no").sortWithinPartitions("task", "line_no")
          .select("task", "line").write.partitionBy("task").text(path))
    parts = [EN.parse_examples(read_raw_lines(spark, f"{path}/task={k}", one_table=True), k).withColumn("task", F.lit(k))
             for k in EN.LAYOUTS]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _lines_cte() -> str:
    from .oracle_views import VIEWS
    return "WITH pairs AS (" + VIEWS["pairs"] + "), lines AS (" + task_lines_sql() + ")"


@query("parse_examples", _lines_cte() + "\n" + _parse_sql())
def q_parse_examples(spark, sf):
    return _parsed(spark, sf).select("task", "line_no", "guid", "text_a", "text_b", "label")


def _label_sql() -> str:
    parts = []
    for task, labels in EN.LABELS.items():
        if EN.OUTPUT_MODES[task] == "regression":
            parts.append(f"SELECT task, line_no, CAST(NULL AS BIGINT) AS label_id, TRY_CAST(label AS DOUBLE) "
                         f"AS label_value FROM parsed WHERE task = '{task}'")
        else:
            lst = "[" + ", ".join(f"'{x}'" for x in labels) + "]"
            parts.append(f"SELECT task, line_no, CAST(coalesce(list_position({lst}, label), 0) - 1 AS BIGINT) "
                         f"AS label_id, CAST(NULL AS DOUBLE) AS label_value FROM parsed WHERE task = '{task}'")
    return "\nUNION ALL\n".join(parts)


@query("label_map", _lines_cte() + ", parsed AS (" + _parse_sql() + ")\n" + _label_sql())
def q_label_map(spark, sf):
    p = _parsed(spark, sf)
    parts = [EN.map_labels(p.where(F.col("task") == k), k) for k in EN.LAYOUTS]
    return reduce(lambda a, b: a.unionByName(b), parts).select("task", "line_no", "label_id", "label_value")


def _swapped_sql() -> str:
    lst = "['contradiction', 'neutral', 'entailment']"
    return f"""SELECT task, line_no, CAST(coalesce(list_position({lst}, label), 0) - 1 AS BIGINT) AS label_id
FROM parsed WHERE task IN ('mnli', 'mnli-mm')"""


@query("label_map_swapped", _lines_cte() + ", parsed AS (" + _parse_sql() + ")\n" + _swapped_sql())
def q_label_map_swapped(spark, sf):
    """E5 for the model family whose last two classes are the other way round."""
    p = _parsed(spark, sf)
    parts = [EN.map_labels(p.where(F.col("task") == k), k, "roberta") for k in ("mnli", "mnli-mm")]
    return reduce(lambda a, b: a.unionByName(b), parts).select("task", "line_no", "label_id")


# ---------------------------------------------------------------- truncation and encoding
@query("truncate_pair", with_views(f"""
SELECT conv_id, turn, la AS len_a, lb AS len_b,
       least(la, greatest(CAST(ceil({MAX_LEN - 3} / 2.0) AS BIGINT), {MAX_LEN - 3} - lb)) AS keep_a,
       least(lb, greatest(CAST(floor({MAX_LEN - 3} / 2.0) AS BIGINT), {MAX_LEN - 3} - la)) AS keep_b
FROM (SELECT conv_id, turn, CAST(len(regexp_extract_all(text_a, '{TOK}')) AS BIGINT) AS la,
             CAST(len(regexp_extract_all(coalesce(text_b, ''), '{TOK}')) AS BIGINT) AS lb FROM pairs)""", "pairs"))
def q_truncate_pair(spark, sf):
    p = X.pairs(_t(spark, sf))
    la = F.size(T.tokens("text_a")).cast("long")
    lb = F.size(T.tokens(F.coalesce(F.col("text_b"), F.lit("")))).cast("long")
    p = p.select("conv_id", "turn", la.alias("len_a"), lb.alias("len_b"))
    ka, kb = EN.truncate_pair_lengths(F.col("len_a"), F.col("len_b"), MAX_LEN - 3)
    return p.select("conv_id", "turn", "len_a", "len_b", ka.cast("long").alias("keep_a"),
                    kb.cast("long").alias("keep_b"))


def _enc_sql(source: str, keys: list[str], a: str, b: str | None, preset: EN.Preset) -> str:
    """DuckDB twin of vocabulary -> token ids -> encode for one preset."""
    k = ", ".join(keys)
    kq = " AND ".join(f"x.{c} = i.{c}" for c in keys)
    b_expr = f"CASE WHEN {b} IS NULL OR {b} = '' THEN NULL ELSE {b} END" if b else "CAST(NULL AS VARCHAR)"
    sb = 4 if preset.sep_extra else 3
    ss = 3 if preset.sep_extra else 2
    m = MAX_LEN - sb
    sep_a = "[3, 3]" if preset.sep_extra else "[3]"
    cls_tok = "list_concat(body, [2])" if preset.cls_at_end else "list_concat([2], body)"
    cls_seg = (f"list_concat(bseg, [{preset.cls_segment}])" if preset.cls_at_end
               else f"list_concat([{preset.cls_segment}], bseg)")
    if preset.pad_left:
        ids = f"list_concat(list_resize(CAST([] AS BIGINT[]), {MAX_LEN} - len(tk), 0), tk)"
        msk = f"list_concat(list_resize(CAST([] AS BIGINT[]), {MAX_LEN} - len(tk), 0), list_resize(CAST([] AS BIGINT[]), len(tk), 1))"
        seg = f"list_concat(list_resize(CAST([] AS BIGINT[]), {MAX_LEN} - len(tk), {preset.pad_segment}), sg)"
    else:
        ids = f"list_resize(tk, {MAX_LEN}, 0)"
        msk = f"list_resize(list_resize(CAST([] AS BIGINT[]), len(tk), 1), {MAX_LEN}, 0)"
        seg = f"list_resize(sg, {MAX_LEN}, {preset.pad_segment})"
    return f"""
WITH ex AS (SELECT {k}, {a} AS ta, {b_expr} AS tb FROM {source}),
toks AS (
  SELECT {k}, 0 AS seg, generate_subscripts(t, 1) AS pos, unnest(t) AS token
    FROM (SELECT {k}, regexp_extract_all(ta, '{TOK}') AS t FROM ex)
  UNION ALL
  SELECT {k}, 1 AS seg, generate_subscripts(t, 1) AS pos, unnest(t) AS token
    FROM (SELECT {k}, regexp_extract_all(tb, '{TOK}') AS t FROM ex WHERE tb IS NOT NULL)),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY cnt DESC, token) - 1 + 4 AS BIGINT) AS token_id
          FROM (SELECT token, count(*) AS cnt FROM toks GROUP BY 1)),
ids AS (SELECT {k}, list(v.token_id ORDER BY t.pos) FILTER (WHERE t.seg = 0) AS ia,
               list(v.token_id ORDER BY t.pos) FILTER (WHERE t.seg = 1) AS ib
        FROM toks t JOIN vocab v ON v.token = t.token GROUP BY {k}),
j AS (SELECT x.{keys[0]}{''.join(', x.' + c for c in keys[1:])}, x.tb IS NOT NULL AS has_b,
             coalesce(i.ia, CAST([] AS BIGINT[])) AS ia,
             CASE WHEN x.tb IS NULL THEN CAST([] AS BIGINT[]) ELSE coalesce(i.ib, CAST([] AS BIGINT[])) END AS ib
      FROM ex x LEFT JOIN ids i ON {kq}),
t1 AS (SELECT *, CASE WHEN has_b THEN least(len(ia), greatest(CAST(ceil({m} / 2.0) AS BIGINT), {m} - len(ib)))
                      ELSE least(len(ia), {MAX_LEN - ss}) END AS ka,
                 CASE WHEN has_b THEN least(len(ib), greatest(CAST(floor({m} / 2.0) AS BIGINT), {m} - len(ia)))
                      ELSE 0 END AS kb FROM j),
t2 AS (SELECT *, list_concat(ia[1:ka], {sep_a}) AS a_part, ib[1:kb] AS b_part FROM t1),
t3 AS (SELECT *, CASE WHEN len(b_part) > 0 THEN list_concat(a_part, b_part, [3]) ELSE a_part END AS body,
              CASE WHEN len(b_part) > 0
                   THEN list_concat(list_resize(CAST([] AS BIGINT[]), len(a_part), {preset.seg_a}),
                                    list_resize(CAST([] AS BIGINT[]), len(b_part) + 1, {preset.seg_b}))
                   ELSE list_resize(CAST([] AS BIGINT[]), len(a_part), {preset.seg_a}) END AS bseg FROM t2),
t4 AS (SELECT *, {cls_tok} AS tk, {cls_seg} AS sg FROM t3)
SELECT {k}, array_to_string({ids}, ' ') AS input_ids, array_to_string({msk}, ' ') AS input_mask,
       array_to_string({seg}, ' ') AS segment_ids FROM t4"""


def _encode_arrays(df, keys, a, b, preset):
    key = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in keys]).alias("_key")
    ex = df.select(*keys, key, F.col(a).alias("ta"),
                   (F.when(F.col(b).isNull() | (F.col(b) == ""), F.lit(None)).otherwise(F.col(b))
                    if b else F.lit(None).cast("string")).alias("tb"))
    vocab = EN.build_vocabulary(ex, ["ta", "tb"])
    ids = EN.token_ids(ex, "_key", ["ta", "tb"], vocab, max_positions=MAX_LEN, carry=tuple(keys))
    return EN.encode(ids, MAX_LEN, preset, "ids_ta", "ids_tb", "len_ta", "len_tb")


def _encode_spark(df, keys, a, b, preset):
    enc = _encode_arrays(df, keys, a, b, preset)
    return enc.select(*keys, *[F.array_join(c, " ").alias(c) for c in ("input_ids", "input_mask", "segment_ids")])


@query("encode_single", _enc_sql("benchmark", ["item_id"], "text", None, EN.PRESETS["default"]))
def q_encode_single(spark, sf):
    return _encode_spark(_t(spark, sf).benchmark, ["item_id"], "text", None, EN.PRESETS["default"])


def _with_pairs(sql: str) -> str:
    """Prefix an encoding oracle (a WITH query) with the ``pairs`` view."""
    from .oracle_views import VIEWS
    return "WITH pairs AS (" + VIEWS["pairs"] + "), " + sql.strip()[len("WITH "):]


@query("encode_pair", _with_pairs(_enc_sql("pairs", ["conv_id", "turn"], "text_a", "text_b", EN.PRESETS["roberta"])))
def q_encode_pair(spark, sf):
    return _encode_spark(X.pairs(_t(spark, sf)), ["conv_id", "turn"], "text_a", "text_b", EN.PRESETS["roberta"])


@query("encode_left_pad", _with_pairs(_enc_sql("pairs", ["conv_id", "turn"], "text_a", "text_b",
                                               EN.PRESETS["xlnet"])))
def q_encode_left_pad(spark, sf):
    return _encode_spark(X.pairs(_t(spark, sf)), ["conv_id", "turn"], "text_a", "text_b", EN.PRESETS["xlnet"])


def _eval_sql() -> str:
    enc = _with_pairs(_enc_sql("pairs", ["conv_id", "turn"], "text_a", "text_b", EN.PRESETS["default"]))
    out = ", ".join(f"""list_sum(list_transform(list_zip(string_split(input_ids, ' '), string_split(input_mask, ' ')),
        lambda x: ((x[1]::BIGINT * {3 + 2 * c} + {7 * c}) % 11) * x[2]::BIGINT)) / 50.0::DOUBLE""" for c in (0, 1))
    return f"""WITH e AS ({enc}),
s AS (SELECT (conv_id + turn) % 2 AS label, row_number() OVER (ORDER BY conv_id, turn) - 1 AS i, [{out}] AS s FROM e),
p AS (SELECT i, label, CASE WHEN s[2] > s[1] THEN 1 ELSE 0 END AS pred,
             ln(exp(s[1] - greatest(s[1], s[2])) + exp(s[2] - greatest(s[1], s[2]))) + greatest(s[1], s[2]) - s[label + 1] AS loss FROM s),
c AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (label = pred)::DOUBLE AS good, 2 * count(*) FILTER (label = 1 AND pred = 1)::DOUBLE AS two,
             (count(*) FILTER (label = 1) + count(*) FILTER (pred = 1))::DOUBLE AS either FROM p),
m AS (SELECT 'acc' AS metric, good / n AS value FROM c UNION ALL SELECT 'f1', CASE WHEN either > 0 THEN two / either ELSE 0 END FROM c
      UNION ALL SELECT 'acc_and_f1', (good / n + CASE WHEN either > 0 THEN two / either ELSE 0 END) / 2 FROM c
      UNION ALL SELECT 'eval_loss', avg(l) FROM (SELECT avg(loss) AS l FROM p GROUP BY i // 8))
SELECT metric, metric || ' = ' || printf('%.6f', value) AS line FROM m"""


@query("evaluate_model", _eval_sql())
def q_evaluate_model(spark, sf):
    """C7 whole: pairs encoded (E2), scored by a model in Arrow batches, largest output, task metrics (C5) and
    batch loss (G8), written as a report (K5) and read back."""
    from ..operators import evaluate as EV
    from ..session import scratch_path
    from ..sources import write_metrics_report
    enc = _encode_arrays(X.pairs(_t(spark, sf)), ["conv_id", "turn"], "text_a", "text_b", EN.PRESETS["default"])
    enc = enc.select(F.struct("conv_id", "turn").alias("at"), ((F.col("conv_id") + F.col("turn")) % 2).alias("label"), *EV.INPUTS)
    path = scratch_path(spark, "eval-model")
    write_metrics_report(EV.evaluate(enc, EV.hashed_linear_model, "mrpc", "at"), path)
    return spark.read.text(path).select(F.split("value", " = ").getItem(0).alias("metric"), F.col("value").alias("line"))
