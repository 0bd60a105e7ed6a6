"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   table folder (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)
    BENCH_RUNS     timed runs per query after one warm-up; the median counts (default 1)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tidebar.catalog import QUERIES  # noqa: E402

HEADLINE = ["ohlcv_bars", "resample_hourly", "asof_hourly", "gap_filter", "continuous", "features_returns", "features_breakout", "features_macd",
            "features_volume", "baseline_features", "rolling_quantile", "volume_profile", "session_context", "target_15m", "triple_barrier",
            "core_audit", "session_span_audit", "backtest", "core_metrics", "spearman", "risk_gates", "split_assignment", "robust_scale", "ridge"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        spent = []
        for run in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if run:
                spent.append(time.perf_counter() - start)
        times[name] = round(statistics.median(spent), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus, "runs": runs}))


if __name__ == "__main__":
    main()
