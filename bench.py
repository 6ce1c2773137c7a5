"""Times the headline queries and prints one JSON line.

Every query is computed in full into a sink that discards its rows.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from waymark.plans.catalog import QUERIES  # noqa: E402
from waymark.session import local_session  # noqa: E402

HEADLINE = [
    "beat_qc_tiers", "record_qc_summary", "unit_persistence", "crosslead_qc_flags", "consensus_quantile", "consensus_repaired", "consensus_record",
    "rr_intervals", "event_windows", "sync_intervals", "boundary_driver_audit", "all_units_worklist", "corrector_batches", "merge_corrections",
    "fit_offsets", "apply_offsets", "stratified_folds", "cut_windows", "confusion_metrics", "landmark_errors", "cluster_bootstrap_record_mean",
    "per_signal_median", "kde_grid", "event_consensus", "spatial_magnitude", "boundaries_5pct", "mode_filter", "landmarks_from_labels",
    "validate_offsets", "crossvalidate_offsets", "compare_systems", "quantile_match_table", "template_average", "rule_based_landmarks", "short_intervals_dropped",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = local_session("bench", cpus=cpus)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    times = {}
    for name in only or HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        if only:
            print(name, times[name], file=sys.stderr)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
