"""Benchmark the headline queries.

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints ONE JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Every query is forced end to end with the ``noop`` sink (full computation,
nothing collected).  One untimed warm-up query runs first.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "city_summary", "comps_load", "latest_per_loan", "stage_counts", "loan_ltv",
    "describe_ratio", "split_exact", "median_impute", "design_matrix", "ols_hc3",
    "fit_summary", "score_batch", "forest_fit_predict", "admin_report", "daily_report",
    "stream_daily_counts", "stream_latest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    from compsight.plans.catalog import QUERIES
    from compsight.session import build_session

    extra = {"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")}
    if not os.environ.get("SPARK_CHECKPOINT_DIR"):
        extra["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    else:
        extra["spark.checkpoint.dir"] = os.environ["SPARK_CHECKPOINT_DIR"]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), extra=extra)
    spark.sparkContext.setLogLevel("ERROR")

    QUERIES["latest_per_loan"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for n in names:
        t0 = time.perf_counter()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
