"""Benchmark headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEATS (default 3), BENCH_QUERIES (comma list or "all"; default the headline set).
Each query runs once to warm up, then ``BENCH_REPEATS`` times through the
``noop`` sink (full execution, nothing collected); the median is reported.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    # EVAL
    "a5_best_at_k_summary", "a5_evaluate_with_missing", "j3_group_best_summary", "a7_reference_speedup",
    # RUNS
    "f1_output_accuracy", "a2_total_runtime", "a3_aligned_repeat_stats", "j9_pair_versions",
    # AUG
    "a13_fastest_accepted", "a14_all_tests_pass", "a8_novelty_filter", "a11_unique_program_count",
    "w7_assign_ids", "j6_sample_context_pairs", "a16_cost_report",
    # RETR
    "j7_knn_join", "f6_fewshot_prompt",
    # PREP
    "f7_training_prompt", "f11_tokenize_and_mask", "w8_performance_tag",
]


def main() -> None:
    from pairlab.plans.queries import REGISTRY
    from pairlab.session import get_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPEATS", "3"))
    wanted = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE))
    names = sorted(REGISTRY) if wanted == "all" else [n for n in wanted.split(",") if n]
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                        conf={"spark.driver.memory": "16g"})
    times = {}
    for name in names:
        build = REGISTRY[name].build
        build(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        runs = []
        for _ in range(reps):
            t0 = time.perf_counter()
            build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": int(cpus), "repeats": reps}))


if __name__ == "__main__":
    main()
