"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowlens.plans.queries import QUERIES  # noqa: E402
from flowlens.session import local_session, ship  # noqa: E402

HEADLINE = [
    "p5_flow_features", "p6_alt_flow_features", "p10_extract_match", "w1_poll_deltas", "e1_expand_snapshots", "e2_expand_replay",
    "a2_aggregate_snapshots_service", "a3_vote_any_attack", "w2_sequence_windows", "w3_split_chronological",
    "w4_split_groups_temporal", "w6_service_baseline", "w7_hit_streak", "w10_hold_window", "r1_scan_support", "r2_bruteforce_support",
    "r5_volumetric_support", "r8_decide_scored", "r9_emit_alerts", "x1_track_flows", "x4_rolling_sequences", "x7_run_status",
    "a10_threshold_at_fpr", "a14_roc_auc", "a19_incidents", "a24_score_normalizer", "a25_fit_robust", "m1_apply_robust",
    "m2_apply_quantile", "j3_correlate_polls", "t2_active_flows", "a21_summarize_run",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "flowlens-bench")
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start the executors
    times = {}
    for name in HEADLINE:
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
