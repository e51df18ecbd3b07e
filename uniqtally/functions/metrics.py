"""Scalar expressions for errors, costs and report formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Report formats and the text for a table that never pays off.
REPORT_DOUBLE_FORMAT = "%.8f"
BREAK_EVEN_FORMAT = "%.2f"
NEVER = "never"


def relative_error(approx: Column, exact: Column) -> Column:
    """|approx - exact| / exact, and 0 where the exact count is 0."""
    approx, exact = approx.cast("double"), exact.cast("double")
    return F.when(exact == 0.0, F.lit(0.0)).otherwise(F.abs(approx - exact) / exact)


def saved_per_query(exact_ms: Column, sketch_ms: Column) -> Column:
    return exact_ms - sketch_ms


def break_even_queries(build_ms: Column, exact_ms: Column, sketch_ms: Column) -> Column:
    """Text: how many repeated queries pay back one build, or ``never``."""
    saved = saved_per_query(exact_ms, sketch_ms)
    return F.when(saved <= 0, F.lit(NEVER)).otherwise(
        F.format_string(BREAK_EVEN_FORMAT, build_ms.cast("double") / saved.cast("double"))
    )


def workload_exact_ms(repeats: int, exact_ms: Column) -> Column:
    return F.lit(repeats).cast("long") * exact_ms


def workload_sketch_ms(repeats: int, build_ms: Column, sketch_ms: Column) -> Column:
    return build_ms + F.lit(repeats).cast("long") * sketch_ms


def size_ratio(raw_bytes: Column, sketch_bytes: Column) -> Column:
    """How many times smaller the sketch table is than the raw table, 0 for an empty one."""
    return F.when(sketch_bytes == 0, F.lit(0.0)).otherwise(
        raw_bytes.cast("double") / sketch_bytes.cast("double")
    )


def report_double(value: Column) -> Column:
    """Fixed-point text of a double; null stays null, so that it is empty in a CSV file."""
    return F.when(value.isNotNull(), F.format_string(REPORT_DOUBLE_FORMAT, value))
