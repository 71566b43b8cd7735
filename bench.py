"""Headline queries on one machine; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tidemark.plans.catalog import QUERIES
from tidemark.session import build_session

HEADLINE = (
    "unified_snapshot", "fault_window_basic", "fault_window_frozen", "maintenance_window_frozen", "operation_window_frozen",
    "fluid_latest_measures", "rolling_fault_features", "rolling_fluid_carried", "segment_operation", "anchor_operation",
    "case_window_operation", "incremental_merge", "column_profile", "range_join_counts", "asof_backward_and_forward",
    "anti_range_windows", "claim_episodes", "next_events", "outcome_history", "stratified_entity_split", "matched_controls",
    "random_ratio_pool", "anchor_feasibility", "ranked_fleet", "auc_and_average_precision", "top_selections", "threshold_curve",
    "ranking_bootstrap", "segment_panel", "controlled_ratio_pool", "correlation_pairs", "top_n_grid", "tier_policy", "feature_inventory", "mutual_information",
)


def main() -> int:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8)))
    spark = build_session("bench", f"local[{cpus}]", cpus, **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    chosen = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in chosen:
        started = time.perf_counter()
        # the no-op sink runs the whole plan without moving rows to the driver
        QUERIES[name].build(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "total wall seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
