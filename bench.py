"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the threads, BENCH_RUNS the timed runs
after one warm-up (the median is reported), BENCH_KEYS a comma list of queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lakewright.plans import load_plans  # noqa: E402

HEADLINE = (
    [f"tpch_q{i}" for i in range(1, 7)] + [f"an_q{i}" for i in range(1, 11)] + [f"oltp_q{i}" for i in range(1, 13)]
    + [f"perf_t{i}" for i in range(1, 6)] + [f"col_t{i}" for i in range(1, 4)] + [f"comp_q{i}" for i in range(1, 6)]
    + ["agg_percentile_cont", "win_running", "win_lag", "win_rank", "ts_exp_smoothing", "cdc_capture", "cdc_apply", "etl_upsert",
       "dq_run", "es_append", "stream_rt_aggregate", "str_text_analysis", "vec_l2_topk", "dup_group"])


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    plans = load_plans()
    chosen = os.environ.get("BENCH_KEYS")
    keys = list(plans) if chosen == "all" else (chosen.split(",") if chosen else HEADLINE)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for key in keys:
        measured = []
        for i in range(runs + 1):
            begin = time.perf_counter()
            plans[key](spark, folder).write.format("noop").mode("overwrite").save()
            if i or runs == 0:
                measured.append(time.perf_counter() - begin)
        times[key] = round(statistics.median(measured), 4)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": folder.rstrip("/").rsplit("/", 1)[-1].removeprefix("sf")}))


if __name__ == "__main__":
    main()
