"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dueday.catalog.base import REGISTRY, Data  # noqa: E402
import dueday.catalog  # noqa: E402, F401
from dueday.session import local_session  # noqa: E402

HEADLINE = [
    "collapse_events",
    "future_dpd30",
    "target_summary",
    "installment_history",
    "previous_app_features",
    "bureau_features",
    "model_table",
    "missing_summary",
    "split_summary",
    "impute_median",
    "classification_metrics",
    "calibration_curve",
    "fairness_metrics",
    "stratified_partition",
]


def run_once(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    # The noop sink computes every column of every row and stores nothing. The
    # rounding that the oracle comparison adds is left out.
    REGISTRY[name].run(Data(spark, sf_dir)).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "dueday-bench")
    spark.sparkContext.setLogLevel("ERROR")
    run_once(spark, "target_summary", sf_dir)  # start-up and code generation
    timings = {name: round(min(run_once(spark, name, sf_dir) for _ in range(2)), 3) for name in names}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
