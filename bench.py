"""Headline timings: one line of JSON.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the cores, ``BENCH_RUNS`` the timed runs
per query (after one warm-up; the median counts), ``BENCH_ONLY`` a comma-separated
choice of queries, or ``all``. Every query runs to its last row into the no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from clickweave.plans.catalog import all_queries  # noqa: E402
from clickweave.session import local_session  # noqa: E402


HEADLINE = (
    "site_bounce_rate",
    "site_avg_time",
    "site_top_pages",
    "site_ctr",
    "site_conversion_rate",
    "site_report_long",
    "site_report_long_window",
    "ingest_normalize",
    "ingest_rejects",
    "fold_sessions",
    "fold_page_views",
    "fold_events",
    "ingest_stream",
    "window_metrics",
    "window_comparison",
    "deployment_rollup",
    "rollup_all_deployments",
    "change_vs_previous_mean",
    "deployment_deltas",
    "sessionize",
    "sessionize_stream",
    "engagement",
    "web_vitals",
    "compact_bursts",
    "section_dwell",
    "over_quota",
    "ab_test",
    "page_components",
    "parse_reply",
    "page_context",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q] or HEADLINE
    spark = local_session(cpus, "bench")
    timings: dict[str, float] = {}
    for name, query in all_queries().items():
        if "all" not in only and name not in only:
            continue
        taken = []
        for i in range(runs + 1):
            began = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                taken.append(time.perf_counter() - began)
        timings[name] = round(statistics.median(taken), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
