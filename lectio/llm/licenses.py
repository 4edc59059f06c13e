"""License scans by diagonal voting, in DataFrame operations only.

Every pair of consecutive words of a text is hashed and joined with the pairs of a small
set of license templates.  A match votes for the diagonal ``word position - template
position``.  Votes are summed by (document, template, diagonal); neighbouring diagonals,
which an inserted or dropped word tells apart, are merged; and a span is verified by the
template pairs it covers.  A template marked exact needs all of its pairs on one diagonal,
which is the phrase itself; the others need a share of ``min_share``.

Rules for odd rows: null text is empty; no words give n_words 0 and empty label strings;
rows with the same id and text share their result; extra columns are not used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import row_key

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`` with its characters one by one, which Java tests by a bit set.
#: It is the words' pattern for any case; in a lower-cased text A-Z do not occur.
WORD = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
SLACK = 3                                             # words that neighbouring diagonals may lie apart
MIN_SHARE = 0.75

#: The phrases that a plain scan looks for, and their labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: Sentences of well-known license texts that name no phrase above, or a narrower license.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation", "gpl"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("gnu lesser general public license", "lgpl"), ("gnu affero general public license", "agpl"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"), ("mozilla public license", "mpl"),
    ("creative commons attribution", "cc-by"), ("cc by nc", "cc-by-nc"), ("cc by sa", "cc-by-sa"), ("cc by nd", "cc-by-nd"),
    ("cc0 1 0 universal", "cc0"), ("eclipse public license", "epl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]


def template_pairs(spark, base=tuple(BASE), more=tuple(TEMPLATES)) -> DataFrame:
    """``hash, w1, w2, tpl, at, pairs, label, exact``: a few hundred rows, fixed by the code."""
    rows = []
    for tpl, (phrase, label) in enumerate([*base, *more]):
        words = phrase.split()
        if not 2 <= len(words) <= 64:
            raise ValueError("a template has 2 to 64 words")
        rows += [(words[i], words[i + 1], tpl, i, len(words) - 1, label, tpl < len(base)) for i in range(len(words) - 1)]
    df = spark.createDataFrame(rows, "w1 string, w2 string, tpl int, at int, pairs int, label string, exact boolean")
    return df.withColumn("hash", F.xxhash64("w1", "w2"))


def votes(docs: DataFrame, templates: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_rid, tpl, diagonal, seen`` and the template's columns; seen has a bit per pair that voted."""
    words = F.regexp_extract_all(F.translate(F.coalesce(text_col, F.lit("")), UPPER, LOWER), F.lit(WORD), 0)
    rolled = (docs.select(row_key(id_col, text_col).alias("_rid"), words.alias("words"))
              .select("_rid", "words", F.posexplode("words").alias("pos", "a"))
              .select("_rid", "pos", "a", F.get("words", F.col("pos") + 1).alias("b")).where("b is not null"))
    hits = rolled.withColumn("hash", F.xxhash64("a", "b")).join(F.broadcast(templates), "hash").where("a = w1 and b = w2")
    bit = F.expr("shiftleft(1L, at)")
    return (hits.groupBy("_rid", "tpl", (F.col("pos") - F.col("at")).alias("diagonal"))
            .agg(F.bit_or(bit).alias("seen"), F.first("pairs").alias("pairs"), F.first("label").alias("label"), F.first("exact").alias("exact")))


def spans(voted: DataFrame, slack: int = SLACK, min_share: float = MIN_SHARE) -> DataFrame:
    """Verified spans ``_rid, tpl, label, exact, start, share``."""
    full = F.bit_count("seen") == F.col("pairs")
    exact = voted.where(F.col("exact") & full).select("_rid", "tpl", "label", "exact", F.col("diagonal").alias("start"), F.lit(1.0).alias("share"))
    w = Window.partitionBy("_rid", "tpl").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(w)
    merged = (voted.where(~F.col("exact")).withColumn("new", (step.isNull() | (step > slack)).cast("int"))
              .withColumn("span", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy("_rid", "tpl", "span").agg(F.bit_or("seen").alias("seen"), F.first("pairs").alias("pairs"), F.first("label").alias("label"),
                                                  F.min("diagonal").alias("start")))
    share = F.bit_count("seen") / F.col("pairs")
    loose = merged.where(share >= min_share).select("_rid", "tpl", "label", F.lit(False).alias("exact"), "start", share.alias("share"))
    return exact.unionByName(loose)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", base=tuple(BASE), more=tuple(TEMPLATES),
         slack: int = SLACK, min_share: float = MIN_SHARE) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    found = spans(votes(docs, template_pairs(docs.sparkSession, base, more), id_col, text_col), slack, min_share)
    labels = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")  # noqa: E731  (a few labels at most)
    per = found.groupBy("_rid").agg(
        F.sum(F.col("exact").cast("long")).alias("n_base"), F.min(F.when(F.col("exact"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("start"))).cast("long").alias("last_word"),
        labels(F.when(F.col("exact"), F.col("label"))).alias("base_labels"), labels(F.col("label")).alias("labels"), F.max("share").alias("score"))
    count = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("_rid"), count.alias("n_words"))
    none = F.lit("")
    return rows.join(per, "_rid", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
