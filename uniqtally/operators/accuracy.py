"""Errors of approximate counts against exact ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uniqtally.functions.metrics import relative_error
from uniqtally.operators.merging import DISTINCT_COUNT

SUMMARY_COLUMNS = (
    "num_groups",
    "exact_cardinality",
    "approximate_cardinality",
    "relative_error_mean",
    "relative_error_median",
    "relative_error_p95",
    "relative_error_max",
)
EXACT_COUNT = "exact_count"
APPROX_COUNT = "approx_count"
RELATIVE_ERROR = "relative_error"


def error_rows(
    exact: DataFrame,
    approx: DataFrame,
    group_cols: Sequence[str],
    null_safe: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Group columns, both counts and the relative error of each group.

    Groups with a null key do not join, unless ``null_safe`` is set. Both inputs are already
    partitioned by their group columns when they come straight from an aggregate, so the join adds
    no shuffle. Without group columns the exact input has one row. ``keep`` names columns of the
    approximate input to carry along, such as its method when it holds the answers of several.
    """
    left = exact.withColumnRenamed(DISTINCT_COUNT, EXACT_COUNT)
    right = approx.withColumnRenamed(DISTINCT_COUNT, APPROX_COUNT)
    if not group_cols:
        joined = right.withColumn(EXACT_COUNT, left.select(EXACT_COUNT).scalar())
    elif not null_safe:
        joined = left.join(right, list(group_cols), "inner")
    else:
        right = right.select(
            *[F.col(name).alias(f"_approx_{name}") for name in group_cols], APPROX_COUNT, *keep
        )
        matches = [F.col(name).eqNullSafe(F.col(f"_approx_{name}")) for name in group_cols]
        joined = left.join(right, matches, "inner")
    return joined.select(
        *keep,
        *group_cols,
        EXACT_COUNT,
        APPROX_COUNT,
        relative_error(F.col(APPROX_COUNT), F.col(EXACT_COUNT)).alias(RELATIVE_ERROR),
    )


def _or_zero(column, name):
    return F.coalesce(column, F.lit(0.0)).alias(name)


def summarize_errors(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Groups, summed counts, and mean, median, 95th percentile and maximum error.

    One row, or one for each value of the columns ``by``.
    """
    error = F.col(RELATIVE_ERROR)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_groups"),
        _or_zero(F.sum(EXACT_COUNT).cast("double"), "exact_cardinality"),
        _or_zero(F.sum(APPROX_COUNT).cast("double"), "approximate_cardinality"),
        _or_zero(F.avg(error), "relative_error_mean"),
        _or_zero(F.percentile_approx(error, 0.5), "relative_error_median"),
        _or_zero(F.percentile_approx(error, 0.95), "relative_error_p95"),
        _or_zero(F.max(error), "relative_error_max"),
    )


def summarize_exact(exact: DataFrame) -> DataFrame:
    """The same row for exact counts themselves: all errors are 0, null groups are included.

    The cardinality of a grouped query is the sum of its groups' counts.
    """
    total = F.coalesce(F.sum(DISTINCT_COUNT).cast("double"), F.lit(0.0))
    return exact.agg(
        F.count(F.lit(1)).alias("num_groups"), total.alias("exact_cardinality")
    ).select(
        "num_groups",
        "exact_cardinality",
        F.col("exact_cardinality").alias("approximate_cardinality"),
        *[
            F.lit(0.0).alias(f"relative_error_{figure}")
            for figure in ("mean", "median", "p95", "max")
        ],
    )
