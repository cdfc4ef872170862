"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from lossgrid.plans.queries import REGISTRY  # noqa: E402
from lossgrid.session import build_session  # noqa: E402

# run again with buckets of a few thousand rows, the paths that large tables take; not part of the total
SMALL_BUCKETS = ["classification_metrics", "capture_lift", "last_balance"]

HEADLINE = [
    "default_events",
    "origination_attach",
    "pd_panel_first",
    "pd_panel_all",
    "monthly_default_rate",
    "severity_dataset",
    "classification_metrics",
    "monthly_performance",
    "capture_lift",
    "calibration_table",
    "calibrated_metrics",
    "psi_table",
    "spearman_matrix",
    "stratified_sample",
    "annual_severity",
    "last_balance",
    "ecl_portfolio",
    "decile_ecl",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def seconds(name: str) -> float:
        start = time.perf_counter()
        REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    names = sys.argv[1:] or HEADLINE
    times = {name: seconds(name) for name in names}
    spark.conf.set("lossgrid.rowsPerBucket", "20000")
    spark.conf.set("lossgrid.rowsPerTask", "50")
    small = {name: seconds(name) for name in SMALL_BUCKETS if name in names}
    line = {
        "metric": "headline queries, total wall time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "small_buckets": small,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
