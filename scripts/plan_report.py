"""Summarise the physical plans of registered queries: shuffles, join
strategies, windows, Python evaluation, codegen spans and scan pushdown.

usage: python scripts/plan_report.py [sf_dir] [name ...]  (writes Markdown to stdout)
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lectio.plans.registry import QUERIES  # noqa: E402
from lectio.session import build_session  # noqa: E402

DEFAULT = ["text_features", "token_surprisal", "surprisal_per_doc", "word_freq_feature", "align_tokens",
           "lookup_surprisal", "join_responses_text", "kfold_assign", "cv_report", "encode_pair", "pool_mean",
           "metric_spearman", "knn_regress", "parse_examples"]

KINDS = ["Exchange", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
         "BroadcastNestedLoopJoin", "CartesianProduct", "Window", "WindowGroupLimit", "HashAggregate",
         "ObjectHashAggregate", "SortAggregate", "Generate", "ArrowEvalPython", "BatchEvalPython",
         "MapInPandas", "FlatMapGroupsInPandas"]


def main():
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf, args = args[0], args[1:]
    spark = build_session(shuffle_partitions=8)
    print("| query | " + " | ".join(["shuffles", "joins", "windows", "aggregates", "python", "codegen stages",
                                     "scan columns"]) + " |")
    print("|---|---|---|---|---|---|---|---|")
    for name in args or DEFAULT:
        df = QUERIES[name](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        full = df._jdf.queryExecution().toString()
        cnt = {k: len(re.findall(r"\b" + k + r"\b", plan)) for k in KINDS}
        joins = ", ".join(f"{cnt[k]} {k}" for k in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
                                                      "BroadcastNestedLoopJoin", "CartesianProduct") if cnt[k])
        py = sum(cnt[k] for k in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas"))
        codegen = len(re.findall(r"\*\(\d+\)", full))
        scans = sorted(set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)))
        print(f"| {name} | {cnt['Exchange']} (+{cnt['BroadcastExchange']} broadcast) | {joins or '-'} | "
              f"{cnt['Window']} ({cnt['WindowGroupLimit']} group-limit) | "
              f"{cnt['HashAggregate'] + cnt['ObjectHashAggregate'] + cnt['SortAggregate']} | {py} | {codegen} | "
              f"{'; '.join(scans)[:120]} |")
    spark.stop()


if __name__ == "__main__":
    main()
