"""Headline queries, timed end to end. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from votelens.plans import load_all  # noqa: E402
from votelens.session import build_session  # noqa: E402

HEADLINE = ["group_report", "aggregate_votes", "curate_frames", "curate_frames_verified", "concept_audit", "concept_ppv", "auroc_ties",
            "threshold_transfer", "rank01", "dedup_by_source_mean", "config_sweep", "escalation_band", "confounded_tail_mine",
            "pseudo_positive_mine", "stratified_folds", "balanced_batches", "bootstrap_challenge", "auroc_ci", "merge_stage_readings", "batch_score"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    queries = load_all().QUERIES
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    times = {}
    for name in os.environ.get("BENCH_QUERIES", "").split() or HEADLINE:
        t = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
