"""Headline benchmark: runs the main queries at $BENCH_SF_DIR on
local[$BENCH_CPUS] and prints ONE JSON line.

Each query is executed in full with the ``noop`` sink (every row is
produced, nothing is collected to the driver) and timed by wall clock.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# name in the report -> registered query
HEADLINE = {
    "breakdown_by_type": "breakdown_by_type",      # view -> classify -> breakdown
    "workspace_files": "workspace_files",          # S1 inventory
    "parse_all": "parse_totals",                   # every file profiled (native + Arrow)
    "markdown_profile": "markdown_profile",
    "generic_profile": "generic_profile",
    "task_report": "task_report",                  # 25 tickets, full report
    "summary_text": "summary_text",                # report family: one parse each
    "task_result_flat": "task_result_flat",
    "run_totals": "run_totals",
    "files_indexed": "files_indexed",
    "breakdown_code": "breakdown_code",
    "ticket_windows_100": "ticket_window_counts",  # 100 tickets
    "ticket_files": "ticket_files",
    "highlights": "highlights",
    "vector_topk": "vector_topk",                  # 1 query
    "vector_topk_batch": "vector_topk_batch",      # 10 queries
    "text_search": "text_search",                  # |benchmark| queries over all documents
    "embed_documents": "embed_documents",
    "topic_counts": "topic_counts",
    "topic_counts_stream": "topic_counts_stream",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from quarry.plans.registry import load_all
    from quarry.session import local_session

    spark = local_session(cores=cpus)
    registry = load_all()
    # warm-up on the smallest scale: JVM code paths, Python workers (pandas
    # import), parquet footers; the timed runs below read ``sf_dir``
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for name in ("workspace_files", "parse_totals", "vector_topk_batch", "task_report"):
        registry[name].build(spark, warm_dir).write.format("noop").mode("overwrite").save()

    times = {}
    for label, name in HEADLINE.items():
        if name not in registry:
            continue
        t0 = time.perf_counter()
        df = registry[name].build(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[label] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
