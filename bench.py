"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line.  Each query is fully evaluated with the no-op sink
(every row computed, nothing collected) after an untimed warm-up pass of the
same queries on the smallest scale factor.  Shuffle bytes per query are read
from Spark's event log, written to a fresh scratch folder."""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["text_features", "token_surprisal", "align_tokens", "mixed_model_fit", "cv_report",
            "knn_regress", "encode_pair", "pool_mean", "word_freq_feature", "lmm_doc_seconds"]


def shuffle_bytes_by_group(log_dir: str) -> dict[str, int]:
    """Sum of shuffle bytes written per job group, from the event log."""
    stage_group, out = {}, {}
    for path in sorted(glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)):
        if not os.path.isfile(path) or os.path.basename(path).startswith("appstatus"):
            continue
        with open(path, encoding="utf-8", errors="replace") as f:
            for line in f:
                try:
                    ev = json.loads(line)
                except ValueError:
                    continue
                if not isinstance(ev, dict):
                    continue
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    g = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        stage_group[sid] = g
                elif kind == "SparkListenerTaskEnd":
                    g = stage_group.get(ev.get("Stage ID"))
                    m = (ev.get("Task Metrics") or {}).get("Shuffle Write Metrics") or {}
                    if g:
                        out[g] = out.get(g, 0) + int(m.get("Shuffle Bytes Written", 0))
    return out


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    log_dir = tempfile.mkdtemp(prefix="lectio-eventlog-")
    from lectio.plans.registry import QUERIES
    from lectio.session import build_session
    spark = build_session(master=f"local[{cpus}]", app="lectio-bench",
                          shuffle_partitions=max(8, 2 * int(cpus)),
                          extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{log_dir}",
                                 "spark.eventLog.compress": "false"})
    sc = spark.sparkContext
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        sc.setJobGroup("warmup", "warm-up")
        for name in names:
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        sc.setJobGroup(name, name)
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"[bench] {name}: {times[name]} s", file=sys.stderr, flush=True)
    spark.stop()
    try:
        shuffled = shuffle_bytes_by_group(log_dir)
    except Exception:  # noqa: BLE001  (metrics are best effort; timings stand alone)
        shuffled = {}
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "shuffle_mb": {k: round(shuffled.get(k, 0) / 1e6, 2) for k in names}}))


if __name__ == "__main__":
    main()
