"""Headline queries, warm session, median of three, results fully materialized.

Prints one JSON line. BENCH_SF_DIR names the table folder, BENCH_CPUS the cores.
"""
from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from scholarsieve.plans.catalogue import QUERIES  # noqa: E402
from scholarsieve.session import local_session  # noqa: E402

HEADLINE = (
    "rule_route_counts", "rule_trace_explode", "lab_compare_rule_versions", "merge_newest_version", "candidate_cap_known",
    "first_k_successes", "full_slot_overflow", "cost_guard_cutoff", "tally_keywords", "located_quote_grounding",
    "abstract_quote_grounding", "html_sections", "section_chunks", "notification_fit",
)
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        taken = []
        for attempt in range(RUNS + 1):
            begin = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if attempt:  # the first run warms code and caches
                taken.append(time.perf_counter() - begin)
        seconds[name] = round(statistics.median(taken), 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": float(scale[1]) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
