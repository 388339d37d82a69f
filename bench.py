"""Timed headline queries; prints one JSON line.

Every query is executed in full with the ``noop`` sink, after a warm-up. ``BENCH_SF_DIR`` names
the data folder and ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from catalog import QUERIES
from catalog.training import run, run_lines
from shardloom.session import local_session

HEADLINE = [
    "b1_shard_contiguous",
    "b3_shard_iid",
    "b5_shard_noniid",
    "b7_train_test_split",
    "b8_to_local_index",
    "b9_shard_stats",
    "b11_dense_index",
    "c1_scale",
    "c5_add_feature_noise",
    "c6_sample_per_participant",
    "c13_exclude_unavailable",
    "d1_label_entropy",
    "d5_select_participants",
    "d6_restrict_to",
    "e1_train_local_units",
    "e5_train_logistic_binary",
    "e10_minibatches",
    "f1_average_weighted_samples",
    "f5_apply_quorum_all",
    "g3_clip_l2",
    "h1_score",
    "h7_classification_metrics",
    "i1_round_duration",
    "i9_duration_stats",
    "i11_compare_fault",
    "j1_admit",
    "j2_within_deadline",
    "j5_participant_status",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session("shardloom-bench", cores)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    # Two runs first, so that no query pays for the start of JVM code and Python workers.
    for name in ("b7_train_test_split", "h1_score"):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    if not sys.argv[1:]:
        # The round loop: 20 rounds over four shards, five local epochs.
        for kind in ("softmax", "mlp"):
            began = time.perf_counter()
            ledger = run(spark, sf_dir, 20, "any", kind).ledger.collect()
            seconds[f"e11_20_rounds_{kind}"] = round(time.perf_counter() - began, 3)
            print(f"{kind}: final accuracy {ledger[-1]['accuracy']:.2f}", file=sys.stderr)
        # Throughput: 5 rounds over all line items, eight shards, each a unit in a task of its own.
        began = time.perf_counter()
        run_lines(spark, sf_dir, 5).ledger.collect()
        seconds["e11_5_rounds_lineitem"] = round(time.perf_counter() - began, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf.group(1)) if sf else None,
            }
        )
    )


if __name__ == "__main__":
    main()
