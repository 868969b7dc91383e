"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from plumbline.queries import CASES

# Heavier or typical queries; BENCH_QUERIES=all runs every one.
HEADLINE = [
    "agg_overall", "slice_by_dimension", "slice_snowflake_chain", "split_by_parent_dim", "agg_distinct_blank",
    "agg_median", "median_filtered", "percentile_inc", "stddev_pop_guard", "avg_of_group_rates",
    "complete_groups", "drill_across_ratio", "treatas_semi_delta", "filtered_count_replace",
    "share_of_visible", "rank_dense", "topn_share", "parent_share_hierarchy", "rollup_subtotals",
    "within_group_percentile", "calc_item_ytd", "same_period_last_year", "metric_slices_long",
    "reconcile_full_outer", "slice_coverage", "keyed_diff", "snapshot_drift", "match_cascade",
    "relationship_profile", "identifier_profile", "edge_closure", "findings_summary", "evidence_explode",
    "pack_distance", "pack_event", "pack_leg", "pack_canonical", "evidence_compare", "risk_propagation", "rollup_median",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = sorted(CASES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="plumbline-bench-"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            begin = time.perf_counter()
            CASES[name].run(spark, path).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begin)
        # The first run warms up code generation and file listings.
        seconds[name] = round(statistics.median(times[1:] or times), 3)
        print(name, seconds[name], file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(path.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
