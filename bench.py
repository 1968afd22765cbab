"""Headline queries on local[BENCH_CPUS] at BENCH_SF_DIR: prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from daywheel.plans import catalog

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "s07_daily_resample",
    "p02_split",
    "w08_supervised",
    "w12_window_stats",
    "f03_split_scaling",
    "a01_persistence_metrics",
    "a03_metrics_by_sets",
    "a11_error_by_magnitude",
    "a15_nonzero_stats",
    "c03b_rain_guided_counts",
    "c05_nearest_centroid",
    "c06_affinity",
    "c14_sigma_candidates",
    "c22_silhouette",
    "m10_multi_step_forecasts",
    "r04_metric_summary",
    "r06_routing_summary",
    "k03_sweep_ranking",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{SF_DIR}/orders.parquet").count()
    queries = catalog.queries()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
