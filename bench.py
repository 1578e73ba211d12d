"""Headline queries, timed one after the other; prints one JSON line.

    BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
    BENCH_CPUS     local threads (default 8)
    BENCH_QUERIES  names to run instead, separated by commas
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from sievelight.plans import feeds
from sievelight.plans.queries import QUERIES
from sievelight.session import build_session

HEADLINE = (
    "document_scan", "table_scan", "content_findings", "sanitized_documents", "contact_counts", "high_entropy_secrets",
    "config_line_rules", "config_tree_rules", "log_line_rules", "brute_force", "log_aggregates", "merged_findings",
    "file_limit", "scan_limit", "baseline_split", "sarif_results", "top_controls", "item_numbers",
    "stream_login_correlation",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.sum("n_chars")).collect()  # start the engine
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    chars = feeds.table(spark, sf_dir, "documents").agg(F.sum("n_chars")).first()[0]
    extra = {}
    if "document_scan" in times:
        extra["document_scan_mchars_per_sec"] = round(chars / times["document_scan"] / 1e6, 2)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), **extra,
            }
        )
    )


if __name__ == "__main__":
    main()
