"""Times the headline queries and prints one JSON line.

Environment: ``BENCH_SF_DIR`` (tables), ``BENCH_CPUS``, ``BENCH_TRIALS``, and ``BENCH_ROWS`` (size of
each generated workload, 0 to leave them out). Each figure is the median of the trials after
one warm-up; every trial computes all rows and columns of the answer.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalogue.queries import (  # noqa: E402
    EXACT_LGK,
    QUERIES,
    events,
    order_lines,
    stored_sketches,
)
from uniqtally.operators import (  # noqa: E402
    ALL_QUERIES,
    approx,
    build_sketch_table,
    exact,
    rollup,
    sketch,
    store_sketch_table,
    time_trials,
)
from uniqtally.sources import (  # noqa: E402
    matrix_parameters,
    normalize_layout,
    scratch_path,
    synthetic,
)

# Registered queries that are timed as they are.
HEADLINE = [
    "theta_two_level_by_day_group",
    "theta_suppliers_by_order",
    "exact_routes_by_pickup",
    "trip_clean",
    "trip_clean_capped",
    "union_pairs_theta",
    "error_summary",
    "error_summary_by_day_group",
    "runtime_stats",
    "cost_model",
    "matrix_summary",
]
WORKLOADS = ("uniform", "high_cardinality", "many_groups", "skewed")


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("uniqtally-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def methods(df, sketch_tables: dict, prefix: str = "") -> dict:
    """Every method on the four queries, without the exact count that checks it."""
    runs = {}
    for query in ALL_QUERIES:
        runs |= {
            f"{prefix}exact_{query.name}": lambda q=query: exact(df, q),
            f"{prefix}hllpp_{query.name}": lambda q=query: approx(df, q),
            f"{prefix}theta_{query.name}": lambda q=query: sketch(df, q, "theta"),
            f"{prefix}hll_{query.name}": lambda q=query: sketch(df, q, "hll"),
        }
        for kind, table in sketch_tables.items():
            runs[f"{prefix}rollup_{kind}_{query.name}"] = lambda q=query, k=kind, t=table: rollup(
                t, q.group_cols, k
            )
    return runs


def registered(spark: SparkSession, sf_dir: str) -> dict:
    """All methods on the events, two on a larger key domain, and the headline queries."""
    by_flag = ALL_QUERIES[1]
    lines = order_lines(spark, sf_dir)
    stored = {
        kind: store_sketch_table(
            events(spark, sf_dir), scratch_path(spark, f"bench-{kind}"), kind=kind
        )
        for kind in ("theta", "hll")
    }
    # The registered pairs of days read a table that is built before it is timed.
    stored_sketches(spark, sf_dir, "theta", EXACT_LGK)
    return (
        methods(events(spark, sf_dir), stored)
        | {
            "exact_orders_by_flag": lambda: exact(lines, by_flag),
            "theta_orders_by_flag": lambda: sketch(lines, by_flag, "theta"),
            "hll_orders_by_flag": lambda: sketch(lines, by_flag, "hll"),
        }
        | {name: (lambda name=name: QUERIES[name](spark, sf_dir)) for name in HEADLINE}
    )


def generated(spark: SparkSession, workload: str, rows: int, cpus: int) -> dict:
    """All methods on a workload at the size and shape of the comparison matrix."""
    distinct, groups = matrix_parameters(workload, rows)
    root = scratch_path(spark, f"bench-{workload}")
    source = synthetic(spark, workload, rows, distinct, groups, days=30, partitions=cpus)
    df = normalize_layout(source, f"{root}/input.parquet")
    # The names of the uniform workload are those of earlier rounds.
    prefix = "generated_" if workload == "uniform" else f"{workload}_"
    builds = {
        # Each split holds a few rows per day and group, so one level of merging will do.
        f"{prefix}build_{kind}": (lambda kind=kind: build_sketch_table(df, kind=kind, slots=1))
        for kind in ("theta", "hll")
    }
    stored = {
        kind: store_sketch_table(df, f"{root}/{kind}", kind=kind)
        for kind in ("theta", "hll")
    }
    return builds | methods(df, stored, prefix)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    trials = int(os.environ.get("BENCH_TRIALS", "3"))
    rows = int(os.environ.get("BENCH_ROWS", "1000000"))
    spark = session(cpus)
    runs = registered(spark, sf_dir)
    for workload in WORKLOADS if rows > 0 else ():
        runs |= generated(spark, workload, rows, int(cpus))
    seconds = {}
    for name, build in runs.items():
        seconds[name] = statistics.median(time_trials(build, 1, trials)) / 1000
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
