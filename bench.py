"""Benchmark: registered queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "report_window_mean", "report_mean_of_means", "report_max_min_count", "report_full", "step_latency",
    "parse_resource_lines", "locf_resources", "missing_workers", "function_union", "triplets", "phase_keys", "phase_visits",
    "profile_batches", "lasso_models", "lasso_replay", "agg_models", "lasso_predict", "running_accuracy", "anomaly_alerts",
    "watch_minutes", "workload_change_log", "run_sample_no", "traffic_chunks", "process_tree", "dump_stacks", "doc_blocks",
    "stats_file_parse", "compare_workloads", "stream_window_mean",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from phasebeat.plans.catalog import QUERIES
    from phasebeat.session import local_session

    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, memory="16g")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("watch_minutes")  # the first query pays for starting the session
    seconds = {name: round(run(name), 3) for name in names}
    result = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }
    if "watch_minutes" in seconds:
        # Per evaluated tick, to set beside the published latencies of predicting, training and scoring one tick.
        evaluated = QUERIES["watch_minutes"](spark, sf_dir).count()
        result["evaluated_ticks"] = evaluated
        result["seconds_per_tick"] = round(seconds["watch_minutes"] / max(evaluated, 1), 9)
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
