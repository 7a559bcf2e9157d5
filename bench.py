"""Benchmark the headline queries.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS``
(default 8), ``BENCH_WARMUP_DIR`` (default /root/testdata/sf0.001). Every
headline query first runs once, untimed, on the warm-up tables; then each is
timed executing in full through the ``noop`` sink (no collect to the driver).
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "parse_records", "scan_text_records", "label_frequency", "label_vocabulary", "multinomial_label",
    "one_hot_columns", "assemble_mixed_vector", "scaler_transform", "row_id", "zip_by_position",
    "lr_multinomial_fit", "model_save_load", "confusion_matrix",
    "flow_numeric_binary", "flow_numeric_multi", "flow_mixed_binary", "flow_mixed_multi",
    "same_host_window", "same_service_window", "last_n_host_window", "category_rollup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from connlearn.session import local_session
    from connlearn.plans.catalog import QUERIES

    spark = local_session(cpus, shuffle_partitions=max(2 * cpus, 8), app_name="connlearn-bench")
    # warm-up: every headline query once on the smallest tables (JIT-compiles
    # the same code paths; not timed)
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for name in HEADLINE:
        try:
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
        except Exception:  # noqa: BLE001 - the timed run reports failures
            pass

    times, failed = {}, {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001 - report and go on with the others
            times[name] = None
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
    m = re.search(r"sf([0-9.]+)", sf_dir.rstrip("/"))
    out = {"metric": "headline_queries_total", "value": round(sum(v for v in times.values() if v), 3),
           "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}
    if failed:
        out["failed"] = failed
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
