"""Benchmark: headline queries, timed on one machine.

Each query runs once to warm up and then three times; the median counts.  The
whole result is consumed (noop sink), nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "column_profile", "dirty_profile", "type_errors", "missing_cells", "occurrences_roundtrip",
    "dataset_scorecard", "delivery_summary", "report_rollup", "issues_by_code", "file_issue_rows",
    "systemic_causes", "failures_by_cause", "alerts", "repair_actions", "metadata_score", "catalog_page",
    "match_files", "incremental_plan", "stratified_sample", "json_rows", "xml_inventory", "duplicate_rows",
    "physical_rows", "payload_sniff",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from sievework.plans import registry
    from sievework.session import local_session

    spark = local_session("bench", cores)
    queries, _sql = registry.load()
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    times: dict[str, float] = {}
    for name in names:
        samples = []
        for _ in range(runs + 1):
            start = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.time() - start)
        times[name] = round(statistics.median(samples[1:] or samples), 3)
    print(json.dumps({
        "metric": "audit_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
