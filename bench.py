"""Time the headline queries, the better of two runs each; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores. Every result is written to the no-op
sink, so the whole result is computed and nothing is collected on the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from foldwise.catalog import load  # noqa: E402
from foldwise.session import local_session  # noqa: E402

HEADLINE = [
    "flagship_crossfit_blend",
    "b7_key_violations",
    "b13_scan_patterns",
    "c1_bind_exact",
    "c7_content_overlap",
    "c8_passage_overlap",
    "c14_proximity_edges",
    "d1_regression_metrics",
    "d18_fingerprint_by_stage",
    "d19_subgroup_metrics",
    "e4_stratified_kfold",
    "e8_paired_bootstrap_blocks",
    "e9_poisson_bootstrap",
    "e12_nested_folds",
    "f3_top_k",
    "j1_feature_filter",
    "j5_block_scaler",
    "l1_assemble_crossfit",
    "l4_prepare_round_robin",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    times = {}

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, directory).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    for name in HEADLINE:
        times[name] = min(run(name), run(name))
    base = os.path.basename(directory)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(base[2:]) if base.startswith("sf") else base,
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
