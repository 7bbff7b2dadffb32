"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local
threads (default 8), BENCH_REPEATS the timed runs per query (after one untimed), of which the median counts.
Arguments, if any, pick queries by a part of their name.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tempograin import plans, session

HEADLINE = [
    "s01_string_csv", "t01_flatten_sides", "j01_inner_join", "a01_status_counts", "a02_demographics", "a04_column_profile",
    "a43_funnel", "w01_first_session", "w05_hysteresis_events", "w07_cycle_verdict", "w09_dominant_period", "w28_lag_scan", "j09_interval_join",
    "c03_cycle_band", "c06_gaussian_smooth", "c08_degrade", "w21_window_blend", "a17_stride_contrasts", "a18_wasserstein", "a19_error_statistics",
    "a25_stability", "e01_group_folds", "e06_roc_auc", "e12_bootstrap_auc", "e14_operating_points", "e17_selective_curve", "e22_benjamini_hochberg",
    "e26_spearman", "e04_inner_choice", "e05_fold_scores", "e35_convention_sensitivity", "g01_body_frame_angles", "g15_frame_quality", "t07_input_checks", "t13_tolerance_regression", "t16_banned_terms"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = session.build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    known = plans.all_queries()
    chosen = [q for q in HEADLINE if not sys.argv[1:] or any(a in q for a in sys.argv[1:])]
    spark.read.parquet(f"{folder}/orders.parquet").count()
    times = {}
    for name in chosen:
        runs = []
        for _ in range(repeats + 1):
            start = time.perf_counter()
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "headline query time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
