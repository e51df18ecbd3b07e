"""Distinct-count analytics on Spark: exact, approximate, and from stored sketches."""

from uniqtally.functions import HLL, THETA, hll_distinct, theta_distinct
from uniqtally.operators import (
    ALL_QUERIES,
    DistinctQuery,
    approx,
    build_sketch_table,
    error_rows,
    exact,
    rollup,
    sketch,
    summarize_errors,
)
from uniqtally.plans import compare, compare_materialized, matrix_summary, run_benchmark
from uniqtally.sources import canonicalize, synthetic, trips

__all__ = [
    "ALL_QUERIES",
    "HLL",
    "THETA",
    "DistinctQuery",
    "approx",
    "build_sketch_table",
    "canonicalize",
    "compare",
    "compare_materialized",
    "error_rows",
    "exact",
    "hll_distinct",
    "matrix_summary",
    "rollup",
    "run_benchmark",
    "sketch",
    "summarize_errors",
    "synthetic",
    "theta_distinct",
    "trips",
]
