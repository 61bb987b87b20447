"""Benchmark the headline queries.

Runs each query once as warm-up, then three times, and reports the median
wall time. Every run executes the full plan into Spark's ``noop`` sink (no
collect to the driver). Prints ONE JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_REPEAT (default 3), BENCH_QUERIES (comma list, optional)
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
    "te_smooth", "te_oof", "te_multi", "te_empirical_bayes", "fold_strat", "label_codes",
    "fill_median", "fill_class_mode", "missing_flags", "composite_scores", "pct_rank_avg",
    "balance_flags", "combos3", "tfidf_combo", "tfidf_docs", "describe_num", "corr_pairs",
    "ks_drift", "histogram", "weight_search", "range_weights", "cv_table", "pseudo_one_sided",
    "sample_rows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE

    from sparkfeat.catalog import queries
    from sparkfeat.session import local_session

    spark = local_session(cpus=cpus, shuffle_partitions=2 * int(cpus), app="sparkfeat-bench")
    q = queries()
    times: dict[str, float] = {}
    for name in names:
        def run() -> float:
            t0 = time.perf_counter()
            q[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0
        run()  # warm-up
        times[name] = round(statistics.median(run() for _ in range(repeat)), 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_median_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
