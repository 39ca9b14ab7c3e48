"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   folder with the tables (default /root/testdata/sf0.1)
BENCH_CPUS     local threads (default 8)

Building the layered tables is timed once, in the cold session; every query is then
timed cold (first run) and warm (median of three). ``value`` is the sum of the warm
times; the cold ones, the writing jobs and the row rates are reported beside it.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from skyledger import queries  # noqa: E402
from skyledger.plans import views  # noqa: E402
from skyledger.plans.layers import layers  # noqa: E402

REPORTS = [
    "active_airlines_now", "delay_patterns", "airline_league", "peak_hours", "airport_congestion",
    "route_efficiency", "aircraft_performance", "weekly_trends", "intl_vs_domestic", "health_scorecard",
]
ROW_JOBS = ["clean_canonical", "exact_dedup", "fuzzy_dedup", "validation_raw"]
JOBS = ["hourly_merge", "incremental_runs", "stream_ingest_raw"]  # a merge, two incremental runs, a stream in six batches; run once
WARM_RUNS = 3


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def seconds(action: Callable[[], None]) -> float:
    begun = time.perf_counter()
    action()
    return round(time.perf_counter() - begun, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
             .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='bench-')}")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    registered, tables = queries.registered(), layers(spark, sf_dir)

    build = {"build_raw": seconds(lambda: tables.raw), "build_clean": seconds(lambda: tables.clean), "build_fact": seconds(lambda: tables.fact),
             "build_dimensions": seconds(lambda: (tables.airlines, tables.airports)),
             "build_day_partials": seconds(lambda: [tables.daily(profile) for profile in views.PROFILES])}
    cold, warm = {}, {}
    for name in REPORTS + ROW_JOBS:
        once = lambda: run(registered[name](spark, sf_dir))  # noqa: B023, E731
        cold[name] = seconds(once)
        warm[name] = round(statistics.median(seconds(once) for _ in range(WARM_RUNS)), 3)
    jobs = {name: seconds(lambda: run(registered[name](spark, sf_dir))) for name in JOBS}  # noqa: B023
    events = tables.raw.count()
    print(json.dumps({
        "metric": "total_warm_seconds", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "sf": Path(sf_dir).name.removeprefix("sf"), "cold": cold, "build": build, "jobs": jobs,
        "rows_per_second": {name: round(events / warm[name]) for name in ROW_JOBS},
    }))


if __name__ == "__main__":
    main()
