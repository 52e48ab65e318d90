"""Time the headline queries and print one JSON line.

Each query runs once to warm up, then BENCH_RUNS times; the figure is the median, from
building the DataFrame to every result row produced.
"""

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tradewind.queries import QUERIES  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

# The KPIs come first, then the marts, the checks and the jobs that store tables.
COLLECTED = (
    "kpi_monthly",
    "kpi_delivery_by_state",
    "kpi_top_sellers",
    "kpi_summary",
    "dq_report",
)
STORED = (
    "int_orders_enriched",
    "fct_seller_revenue",
    "order_payments_sum",
    "fct_orders_full",
    "cast_columns",
    "csv_roundtrip",
    "partition_by_month",
    "reload_month",
    "clustered_write",
    "ingest_reviews",
    "fct_orders_incremental",
    "monthly_job_orders",
    "backfill_delivery",
)


def run(spark: SparkSession, name: str) -> float:
    start = time.perf_counter()
    df = QUERIES[name](spark, SF_DIR)
    if name in COLLECTED:
        df.collect()
    else:
        df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in COLLECTED + STORED:
        run(spark, name)
        timings[name] = round(statistics.median(run(spark, name) for _ in range(RUNS)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total of the median query times",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
