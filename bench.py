"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores,
BENCH_QUERIES an optional comma-separated subset.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from countwatch.plans.registry import QUERIES  # noqa: E402
from countwatch.session import build_session  # noqa: E402

HEADLINE = (
    "m01_monthly_count", "m01_spine_variance", "m02_lag_matched", "exclusion_receipt", "record_facts", "record_first_seen",
    "cohort_gate", "capacity_windows", "gate_results", "recall_timeline", "recall_count", "ranges", "ets_fit", "forecast",
    "score_cells", "review_workload", "lanes", "token_scan", "hash_reconcile", "stream_daily_counts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "countwatch-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="countwatch-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["m01_monthly_count"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM's engines
    took: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total seconds", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
