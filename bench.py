"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line, median of three runs after a warm-up."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = ["A23_error_summary", "A27_rollup", "A28_cube", "A30_correlation_matrix", "J01_inner_join", "J06_range_join", "J07_enrichment", "J08_asof", "J20_weighted_sum", "O06_top_k", "W01_prefix_sum", "W07_reuse_same", "W08_reuse_other", "W12_downsample", "A06_run_length", "G15_spmv", "X18_md5", "S07_regex_metrics"]


def main() -> None:
    from pyspark.sql import SparkSession

    from millrace.plans.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        seconds = []
        for _ in range(4):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - began)
        took[name] = round(median(seconds[1:]), 4)
    spark.stop()
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
