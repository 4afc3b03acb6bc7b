"""Benchmark: run the headline queries and print one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS``
(default 8). Each query is executed in full through the ``noop`` sink, so the
timing covers scan, shuffles, windows and output without moving rows to
Python. One untimed warm-up query runs first (JVM start, code generation).
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
    "panel_sum",
    "csv_source",
    "csv_rows_with_ledger",
    "row_account",
    "topk_value",
    "topk_lines",
    "codes_in_order",
    "calendar_features",
    "lag_frame_backward",
    "lag_frame_raw_balanced",
    "lag_frame_incremental",
    "short_series_filter",
    "ffill_series",
    "ffill_frame",
    "time_split_train",
    "mape_by_split",
    "mape_by_code",
    "zscore",
    "zscore_merged",
    "label_within_30d",
    "step_ratio_smoothed",
    "ratio_extrapolate",
    "ratio_extrapolate_cyclic",
    "ratio_extrapolate_raw_balanced",
    "history_plus_forecast_features",
    "mape_by_code_positional",
    "gbt_fit_predict",
    "gbt_early_stop",
    "forecast_all_codes",
    "forecast_csv_sink",
    "forecast_packed_sink",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from panelcast.plans.registry import queries
    from panelcast.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          app_name="panelcast-bench")
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="panelcast-bench-"))
    q = queries()

    def run(name: str) -> float:
        t0 = time.perf_counter()
        q[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run("panel_sum")  # warm-up, not timed
    times = {name: round(run(name), 3) for name in HEADLINE}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
