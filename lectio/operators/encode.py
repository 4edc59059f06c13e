"""Sequence-task examples (E1), labels (E5), fixed-length encoding.

Everything is native array expressions: field extraction from split lines,
closed-form pair truncation, special tokens, segment ids, masks and padding.
Token ids come from a corpus vocabulary (id by descending count, then token)
attached with an explode -> join -> ordered regroup, so the vocabulary is
never broadcast whole and a long example is one row, not a Python loop.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .indexing import with_row_index

# ---- fixed values -------------------------------------------------------
# Field layout per task: 0-based field index, -1 = last field, None = absent,
# "row" = the line's index in its file.  header: first line is skipped.
LAYOUTS = {
    "mrpc":    dict(guid="row", a=3, b=4, label=0, header=True, min_fields=None),
    "mnli":    dict(guid=0, a=8, b=9, label=-1, header=True, min_fields=None),
    "mnli-mm": dict(guid=0, a=8, b=9, label=-1, header=True, min_fields=None),
    "cola":    dict(guid="row", a=3, b=None, label=1, header=False, min_fields=None),
    "sst-2":   dict(guid="row", a=0, b=None, label=1, header=True, min_fields=None),
    "sts-b":   dict(guid=0, a=0, b=None, label=-1, header=True, min_fields=None),
    "qqp":     dict(guid=0, a=3, b=4, label=5, header=True, min_fields=6),
    "qnli":    dict(guid=0, a=1, b=2, label=-1, header=True, min_fields=None),
    "rte":     dict(guid=0, a=1, b=2, label=-1, header=True, min_fields=None),
    "wnli":    dict(guid=0, a=1, b=2, label=-1, header=True, min_fields=None),
}
LABELS = {
    "cola": ["0", "1"],
    "mnli": ["contradiction", "entailment", "neutral"],
    "mnli-mm": ["contradiction", "entailment", "neutral"],
    "mrpc": ["0", "1"],
    "sst-2": ["0", "1"],
    "sts-b": [None],
    "qqp": ["0", "1"],
    "qnli": ["entailment", "not_entailment"],
    "rte": ["entailment", "not_entailment"],
    "wnli": ["0", "1"],
}
OUTPUT_MODES = {task: ("regression" if task == "sts-b" else "classification") for task in LAYOUTS}
# special token ids of the corpus vocabulary
PAD_ID, UNK_ID, CLS_ID, SEP_ID = 0, 1, 2, 3
FIRST_TOKEN_ID = 4
# -------------------------------------------------------------------------


@dataclass(frozen=True)
class Preset:
    """Encoding conventions (E2/E4): default = class token first, right padding;
    ``xlnet`` style = class token last, class segment 2, left padding, pad
    segment 4; ``roberta`` style = extra separator after text a."""
    cls_at_end: bool = False
    cls_segment: int = 0
    sep_extra: bool = False
    pad_left: bool = False
    pad_segment: int = 0
    seg_a: int = 0
    seg_b: int = 1


PRESETS = {"default": Preset(), "xlnet": Preset(True, 2, False, True, 4), "roberta": Preset(sep_extra=True)}


def _field(fields: Column, idx):
    if idx is None:
        return F.lit(None).cast("string")
    return F.try_element_at(fields, F.lit(-1 if idx == -1 else idx + 1))


def parse_examples(lines: DataFrame, task: str, set_type: str = "train",
                   line_no: str = "line_no", line: str = "line") -> DataFrame:
    """E1 (+P4, P5, W3): split tab-separated lines by the task's layout into
    (line_no, guid, text_a, text_b, label).  Missing fields are null."""
    lay = LAYOUTS[task]
    fields = F.split(F.col(line), "\t", -1)
    df = lines.withColumn("_f", fields)
    if lay["header"]:
        df = df.where(F.col(line_no) > 0)
    if lay["min_fields"]:
        df = df.where(F.size("_f") >= lay["min_fields"])
    gid = F.col(line_no).cast("string") if lay["guid"] == "row" else _field(F.col("_f"), lay["guid"])
    return df.select(F.col(line_no), F.concat(F.lit(f"{set_type}-"), gid).alias("guid"),
                     _field(F.col("_f"), lay["a"]).alias("text_a"),
                     _field(F.col("_f"), lay["b"]).alias("text_b"),
                     _field(F.col("_f"), lay["label"]).alias("label"))


def map_labels(examples: DataFrame, task: str, model_type: str = "default",
               label: str = "label") -> DataFrame:
    """E5: class index in the task's label list (-1 when unknown, counted by
    P8), or the float value for regression."""
    if OUTPUT_MODES[task] == "regression":
        return examples.withColumn("label_id", F.lit(None).cast("long")) \
                       .withColumn("label_value", F.col(label).try_cast("double"))
    labels = list(LABELS[task])
    if task in ("mnli", "mnli-mm") and model_type == "roberta":
        labels[1], labels[2] = labels[2], labels[1]
    arr = F.array(*[F.lit(x) for x in labels])
    return (examples.withColumn("label_id", (F.coalesce(F.array_position(arr, F.col(label)), F.lit(0)) - 1).cast("long"))
                    .withColumn("label_value", F.lit(None).cast("double")))


def build_vocabulary(texts: DataFrame, cols: list[str]) -> DataFrame:
    """(token, token_id): ids from ``FIRST_TOKEN_ID`` by descending corpus
    count, ties by token.  Counting uses partial aggregation; the ranking is
    a distributed row index (no single-partition window)."""
    toks = None
    for c in cols:
        t = texts.select(F.explode(T.tokens(c)).alias("token"))
        toks = t if toks is None else toks.unionByName(t)
    counts = toks.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))
    idx = with_row_index(counts.withColumn("_neg", -F.col("cnt")), ["_neg", "token"], "_r")
    return idx.select("token", (F.col("_r") + FIRST_TOKEN_ID).alias("token_id"))


def token_ids(examples: DataFrame, key: str, cols: list[str], vocab: DataFrame,
              max_positions: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, the columns of ``carry``, ids_<col>, len_<col> ...): each text's token ids in order (unknown
    -> UNK) and its full token count; counts are taken before the join, so no text is shuffled.  With ``max_positions`` only the first
    positions, the only ones an encoding of that length can keep, are looked
    up, so a 20,000-token text costs ``max_positions`` joined rows; the count
    still covers the whole text."""
    parts = None
    for i, c in enumerate(cols):
        e = examples.select(key, F.lit(i).alias("_seg"), F.posexplode(T.tokens(c)).alias("_pos", "token"))
        if max_positions is not None:
            e = e.where(F.col("_pos") < max_positions)
        parts = e if parts is None else parts.unionByName(e)
    j = parts.join(vocab, "token", "left").withColumn("token_id", F.coalesce("token_id", F.lit(UNK_ID)))
    aggs = []
    for i, c in enumerate(cols):
        pieces = F.array_sort(F.collect_list(F.when(F.col("_seg") == i, F.struct("_pos", "token_id"))))
        aggs.append(F.transform(pieces, lambda s: s["token_id"]).alias(f"ids_{c}"))
    grouped = j.groupBy(key).agg(*aggs)
    absent = {c: F.col(c).isNull() | (F.col(c) == "") for c in cols}
    out = examples.select(key, *carry, *[F.when(~absent[c], F.size(T.tokens(c))).alias(f"len_{c}") for c in cols]).join(grouped, key, "left")
    for c in cols:
        out = out.withColumn(f"ids_{c}", F.when(F.col(f"len_{c}").isNotNull(), F.coalesce(F.col(f"ids_{c}"), F.array().cast("array<long>"))))
    return out


def truncate_pair_lengths(len_a: Column, len_b: Column, budget: int):
    """E3 closed form of the greedy rule 'pop from the longer, ties pop b'."""
    m = F.lit(budget)
    ka = F.least(len_a, F.greatest(F.lit(-(-budget // 2)), m - len_b))
    kb = F.least(len_b, F.greatest(F.lit(budget // 2), m - len_a))
    return ka, kb


def encode(ids: DataFrame, max_len: int, preset: Preset = Preset(), a: str = "ids_a",
           b: str | None = "ids_b", len_a: str | None = None, len_b: str | None = None) -> DataFrame:
    """Fixed-length input_ids / input_mask / segment_ids arrays.  The
    truncation uses the full token counts (``len_a`` / ``len_b`` columns when
    the id arrays were cut to the first positions, else the array sizes)."""
    has_b = F.col(b).isNotNull() if b else F.lit(False)
    la = F.coalesce(F.col(len_a) if len_a else F.size(a), F.lit(0))
    lb = (F.coalesce(F.col(len_b) if len_b else F.size(b), F.lit(0))) if b else F.lit(0)
    single_budget = max_len - (3 if preset.sep_extra else 2)
    pair_budget = max_len - (4 if preset.sep_extra else 3)
    ka, kb = truncate_pair_lengths(la, lb, pair_budget)
    keep_a = F.when(has_b, ka).otherwise(F.least(la, F.lit(single_budget)))
    keep_b = F.when(has_b, kb).otherwise(F.lit(0))
    arr_a = F.slice(F.coalesce(F.col(a), F.array().cast("array<long>")), 1, keep_a)
    arr_b = F.slice(F.coalesce(F.col(b), F.array().cast("array<long>")), 1, keep_b) if b else F.array().cast("array<long>")
    sep = F.array(F.lit(SEP_ID).cast("long"))
    seps_a = F.concat(sep, sep) if preset.sep_extra else sep
    tok = F.concat(arr_a, seps_a)
    seg = F.array_repeat(F.lit(preset.seg_a), F.size(tok))
    # pair truncation applies whenever text b exists; its segment only when
    # it kept at least one token
    append_b = F.size(arr_b) > 0
    tok = F.when(append_b, F.concat(tok, arr_b, sep)).otherwise(tok)
    seg = F.when(append_b, F.concat(seg, F.array_repeat(F.lit(preset.seg_b), F.size(arr_b) + 1))).otherwise(seg)
    cls = F.array(F.lit(CLS_ID).cast("long"))
    cseg = F.array(F.lit(preset.cls_segment))
    if preset.cls_at_end:
        tok, seg = F.concat(tok, cls), F.concat(seg, cseg)
    else:
        tok, seg = F.concat(cls, tok), F.concat(cseg, seg)
    out = ids.withColumn("_tok", tok).withColumn("_seg", seg)
    pad_n = F.lit(max_len) - F.size("_tok")
    pad_ids = F.array_repeat(F.lit(PAD_ID).cast("long"), pad_n)
    pad_mask = F.array_repeat(F.lit(0), pad_n)
    pad_seg = F.array_repeat(F.lit(preset.pad_segment), pad_n)
    mask = F.array_repeat(F.lit(1), F.size("_tok"))
    if preset.pad_left:
        cols = (F.concat(pad_ids, "_tok"), F.concat(pad_mask, mask), F.concat(pad_seg, "_seg"))
    else:
        cols = (F.concat("_tok", pad_ids), F.concat(mask, pad_mask), F.concat("_seg", pad_seg))
    return (out.withColumn("input_ids", cols[0]).withColumn("input_mask", cols[1])
               .withColumn("segment_ids", cols[2]).drop("_tok", "_seg"))
