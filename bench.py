"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores (default 8).
Each query is written to the ``noop`` sink, so all of its rows are made and none are kept.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from strandset.plans.catalog import QUERIES

HEADLINE = """
weighted_burden burden_score_stat gene_tests skat_burden band_census floor_ladder_fmi bridge_join co_carriers
interval_overlap nearest_point asof_tolerance merge_intervals active_count point_in_interval chain_loci sliding_windows
avg_rank ecdf_reference topk_tiebreak bh_stepup ld_r2_pairs mutual_information hash_permutation matched_null
haplo_states components scope_rollup regression_residuals source_consistency
""".split()


def session(cpus: str) -> SparkSession:
    shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.local.dir", shared)
        .config("spark.checkpoint.dir", f"file://{shared}/checkpoints")
        .config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .getOrCreate()
    )


def seconds(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    seconds(spark, "weighted_burden", sf_dir)  # the first run loads classes and is not counted
    times = {}
    for name in HEADLINE:
        times[name] = round(seconds(spark, name, sf_dir), 3)
        print(f"{name}: {times[name]} s", file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
