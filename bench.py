"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line.

Each query is run once to warm the JVM and the Python workers and then timed, writing to the
``noop`` sink so that every row and column is produced and none is collected. The line also has the events a
second of the flagship query and the recall of dense and hybrid retrieval on the supplied passages.
"""

from __future__ import annotations

import json
import os
import sys
import time

from factfold.plans import QUERY_MODULES
from factfold.plans.registry import QUERIES
from factfold.session import build_session

HEADLINE = (
    "cloud_state", "fold_consensus", "fold_with_resolutions", "device_trust", "explain_verdicts", "stamp_consensus_state",
    "evidence_packets", "capture_decisions", "possible_conflicts", "value_clusters", "bm25_topk", "dense_topk",
    "hybrid_global", "select_batch", "eviction_plan", "ingest_events", "redact_text", "score_resolver_vs_lww",
)
# The branches for large tables with small blocks; timed, but not part of the total.
BRANCHES = ("bm25_by_join", "dense_topk_blocks", "conflicts_pruned", "value_clusters_rounds")


def main() -> None:
    assert QUERY_MODULES
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("factfold-bench", cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    timings: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE + BRANCHES:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        timings[name] = round(best, 3)
        print(f"{name}: {best:.2f}s", file=sys.stderr)
    more = {}
    if not sys.argv[1:]:
        events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
        more["events_per_second"] = round(events / timings["cloud_state"])
        recall = QUERIES["score_recall"](spark, sf_dir).filter("shape = 'all'").first()
        more |= {"dense_recall_at_5": recall["dense_recall"], "hybrid_recall_at_5": recall["hybrid_recall"]}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(t for n, t in timings.items() if n not in BRANCHES), 3), "unit": "sec",
                      "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                      "cpus": cpus} | more))


if __name__ == "__main__":
    main()
