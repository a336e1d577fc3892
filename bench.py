"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of the parquet tables, BENCH_CPUS the number of local cores.
Each query runs once to warm up and three times for the median; results go to Spark's noop sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from seriesloom.storage import released_tables  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = ("growth", "event_growth", "next_peak_chunk", "event_peak_sliding", "minmax_normalize",
            "normalized_panel", "mobility_factor", "air_traffic", "inbound_with_cases", "profile",
            "unmatched_keys", "granger_lag1", "granger_scan", "granger_panel", "granger_pooled",
            "granger_events")
RUNS = 3


def session(cpus: str) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
             .config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(spark: SparkSession, name: str, sf_dir: str) -> float:
    with released_tables(spark):
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", str(os.cpu_count())))
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        seconds(spark, name, sf_dir)
        times[name] = round(statistics.median(seconds(spark, name, sf_dir) for _ in range(RUNS)), 3)
    print(json.dumps({
        "metric": "total time of headline queries, warm, median of 3", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "spark": spark.version, "cores": spark.sparkContext.defaultParallelism}))
    spark.stop()


if __name__ == "__main__":
    main()
