"""Times the headline queries and prints one JSON line.

Each query is written to the no-op sink, so every column of every row is computed.  The time of a
query is the best of ``BENCH_RUNS`` warm runs after one warm-up run.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from crosstally.plans.registry import QUERIES  # noqa: E402
from crosstally.session import LAUNCH_SETTINGS  # noqa: E402

HEADLINE = (
    "variance_fleet_store_week",
    "variance_summary",
    "top_variances",
    "variance_by_store",
    "fleet_store_month",
    "line_enriched",
    "product_totals",
    "store_product_mix",
    "service_type_rollup",
    "scope_lines",
    "q1_org_services",
    "q5_service_mix",
    "q6_size_tiers",
    "q10_lost_revenue",
    "dq_subtotal_vs_lines",
    "doc_catalog_summary",
)


def run(spark: SparkSession, directory: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        # Each test table is one row group, hence one scan task.  A low threshold keeps the two
        # fact tables on the shuffle join they would get at scale, which also uses all cores.
        .config("spark.sql.autoBroadcastJoinThreshold", "1m")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(map=LAUNCH_SETTINGS)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        run(spark, directory, name)
        times[name] = round(min(run(spark, directory, name) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(directory).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
