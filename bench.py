"""Headline queries, timed end to end (sources to a no-op sink). Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = ["daily_leaders", "rolling_sum_mean", "rolling_median", "recursive_smoothing", "rank_correlation_52",
            "percent_rank_avg_ties", "percent_rank_split_groups", "group_zscore", "gauss_rank", "asof_financials",
            "asof_sector_shorts", "volume_features", "fundamental_features", "strategic_barrier", "universe_flags",
            "thin_bars", "purged_kfold", "fold_metrics", "missing_report", "equity_curve"]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.codegen.hugeMethodLimit", "8000").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from catalog import load
    qs = load()
    spark.read.parquet(f"{root}/lineitem.parquet").groupBy("l_suppkey").count().write.format("noop").mode("overwrite").save()
    cold, warm = {}, {}
    for n in names:
        times = []
        for _ in range(1 + max(runs, 1)):
            t0 = time.time()
            qs[n].run(spark, root).write.format("noop").mode("overwrite").save()
            times.append(time.time() - t0)
        cold[n], warm[n] = round(times[0], 3), round(statistics.median_low(times[1:]), 3)
    print(json.dumps({"metric": "total_warm_query_time", "value": round(sum(warm.values()), 3), "unit": "sec",
                      "queries": warm, "cold": cold, "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
