"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query is computed in full: its rows go to the no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from evenkeel.suite.fixtures import read
from evenkeel.suite.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "data_summary_orders", "row_diff_orders", "row_presence_orders", "cell_diff_orders",
    "cell_diff_customer_clean", "same_rows", "surplus_rows", "count_check", "null_pct",
    "distinct_count", "min_max", "sum_recon", "metric_compare", "value_distribution",
    "duplicate_keys", "key_candidates", "business_checks", "missing_rows",
    "missing_rows_null_aware", "orphan_rows", "key_difference", "incremental_window",
    "normalised_projection", "normalise_json", "fuzzy_top_n", "match_decisions",
    "schema_presence", "exclusions", "table_presence", "match_tables", "learned_top_k",
    "column_coverage", "usage_cost", "batch_run", "keyless_validation", "full_run",
    "suggest_targets", "co_located_diff_orders", "distinct_sketches",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("evenkeel-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("data_summary_orders")  # start the JVM's workers and compilers
    seconds = {name: run(name) for name in HEADLINE}
    rows = read(spark, SF_DIR, "orders").count()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "rows_per_side_per_sec": {
                    q: round(rows / seconds[q])
                    for q in ("data_summary_orders", "cell_diff_orders", "row_presence_orders")
                },
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
