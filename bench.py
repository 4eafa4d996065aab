"""Headline queries on one data folder; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query is run in full: its rows are all written to a no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from strideframe.plans.registry import Tables, load_all
from strideframe.session import local_session

HEADLINES = [
    "c01_inner_join", "c07_window_label_by_overlap", "d05_aggregate_by_name", "d11_percentile_95", "e04_label_runs", "i06_tumbling_summary", "i11_window_stats", "i12_window_features", "i13_periodicity",
    "j05_mode_smoothing", "j06_short_run_fill", "k07_version_scores", "l02_met_calories", "l05_session_muscle_score", "l06_group_share", "l10_balance_score", "l11_week_totals", "m04_candidate_pool",
    "m08_nearest_documents", "n01_name_resolution", "o05_frame_scores", "p07_activity_sessions",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    plans, times = load_all(), {}
    spark.read.parquet(f"{folder}/region.parquet").count()  # start the executors before timing
    for name in HEADLINES:
        t0 = time.perf_counter()
        plans[name].plan(Tables(spark, folder)).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
