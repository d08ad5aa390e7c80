"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR  folder with the parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_ALL     set to 1 to time every registered query
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dossierlake import session  # noqa: E402
from dossierlake.plans.catalogue import QUERIES  # noqa: E402
from dossierlake.plans.q_compare import prepare_indexes  # noqa: E402

HEADLINE = [
    "facility_pattern", "quant_flags", "measure_stats", "page_stats", "submission_vs_cohort", "keyword_lift",
    "page_merge", "page_spine", "contiguous_runs", "measure_resolution", "guideline_tree", "file_conflicts",
    "source_contradictions", "requirement_coverage", "duplicate_sets", "run_difference", "citation_bounds",
    "number_grounding", "scoring_focus", "scoring_table", "area_blocks", "feasibility_sites", "gap_analysis",
    "document_search", "or_search", "eval_summary", "drift_audit", "document_blocks", "cell_grid",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = list(QUERIES) if os.environ.get("BENCH_ALL") == "1" else HEADLINE
    spark = session.build("bench")
    # warm up the JVM and the scan path, not any measured query
    spark.read.parquet(f"{folder}/nation.parquet").groupBy("n_regionkey").count().write.format("noop").mode("overwrite").save()
    # stored structures are written once and read by many queries: their time is given apart
    start = time.perf_counter()
    if any("search" in n for n in names):
        prepare_indexes(spark, folder)
    prepared = round(time.perf_counter() - start, 3)
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline query set, wall clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "search_index_build_sec": prepared,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
