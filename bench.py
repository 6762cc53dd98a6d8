"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query reads the driver's tables, runs in full and throws its rows away.
One small query runs first, so that no timing contains the start of the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.spark_queries import QUERIES  # noqa: E402
from eventloom.session import configure  # noqa: E402

HEADLINE = (
    "kpi_snapshot",
    "dau",
    "stickiness_dau_mau_orders",
    "monthly_revenue_orders",
    "revenue_by_country",
    "traffic_source_analysis",
    "funnel",
    "retention_overall_rate",
    "campaign_growth_orders",
    "country_device_matrix",
    "top_cities",
    "user_level_aggregate",
    "user_first_and_activity_dates",
    "campaign_comparison",
    "warehouse_cohort_months",
    "clean_for_batch",
    "batch_kpis_orders",
    "dashboard_kpis",
    "period_comparison",
    "segmentation",
    "summary_table_country",
    "cohort_table_orders",
    "rfm_table",
    "rfm_segment_summary",
    "warning_cards",
    "retention_heatmap",
    "duration_histogram",
    "duration_density",
    "live_insights",
    "recommendations",
    "batch_report_job",
    "json_report_file",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("eventloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["row_count"](spark, folder).collect()

    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline queries", "value": total, "unit": "sec", "queries": seconds,
                      "sf": Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
