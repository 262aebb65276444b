"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose data and cores. Each query runs once to warm up and then
three times; the middle time counts. Every run writes all its rows to Spark's noop sink.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from codesieve.plans.corpora import LINES_PER_FILE, table
from codesieve.plans.queries import QUERIES
from codesieve.session import build_session

HEADLINE = (
    "scan_issues_all", "rules_js", "rules_java", "rules_python_blocks", "rules_sql_statements",
    "rules_json_keys", "rules_json_depth", "secrets_in_documents", "issue_summary", "scan_diff",
    "knowledge_hits", "knowledge_misses", "cache_ttl_lookup", "rate_audit", "review_batches",
    "answers_normalised", "review_overlay", "context_snippet", "language_inventory",
    "scan_history_topk", "latest_scan_per_repo", "trend", "text_report", "export_table",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session("codesieve-bench", f"local[{cpus}]", **{
        "spark.driver.memory": "12g",
        "spark.sql.shuffle.partitions": cpus,
        # Local data is a few MB; partitions of the default least size would leave cores idle.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in HEADLINE:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(3)), 3)
    lines = table(spark, sf_dir, "orders").count()
    scan = times["scan_issues_all"]
    print(json.dumps({
        "metric": "total seconds of the headline queries, warm, median of 3",
        "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
        "scan_files_per_sec": round(lines / LINES_PER_FILE / scan, 1),
        "scan_lines_per_sec": round(lines / scan),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
