import math

import pytest
from plan_text import plan_of
from pyspark.sql import functions as F

from uniqtally.functions import (
    break_even_queries,
    relative_error,
    report_double,
    size_ratio,
    workload_exact_ms,
    workload_sketch_ms,
)
from uniqtally.operators import (
    ALL_QUERIES,
    approx,
    error_rows,
    evaluate,
    exact,
    runtime_stats,
    summarize_errors,
    summarize_exact,
    time_trials,
    trial_rows,
    trials_frame,
)
from uniqtally.sources import synthetic

COUNTS = "group_id string, distinct_count bigint"


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def counts(spark, **groups):
    return spark.createDataFrame(
        [(None if g == "null" else g, n) for g, n in groups.items()], COUNTS
    )


def test_relative_error(spark):
    def error(approx_count, exact_count):
        return one(spark, relative_error(F.lit(approx_count), F.lit(exact_count)))

    assert error(5, 0) == 0.0
    assert error(9, 10) == pytest.approx(0.1)
    assert error(12.0, 10) == pytest.approx(0.2)


def test_null_groups_join_only_on_request(spark):
    left, right = counts(spark, a=10, null=5), counts(spark, a=9, null=5)
    assert error_rows(left, right, ["group_id"]).count() == 1
    safe = error_rows(left, right, ["group_id"], null_safe=True)
    assert safe.columns == ["group_id", "exact_count", "approx_count", "relative_error"]
    assert {row.group_id for row in safe.collect()} == {"a", None}
    assert summarize_exact(left).first().num_groups == 2


def test_error_summary(spark):
    left = counts(spark, **{f"g{n}": 100 for n in range(20)})
    right = counts(spark, **{f"g{n}": 100 + n for n in range(20)})
    row = summarize_errors(error_rows(left, right, ["group_id"])).first()
    assert row.num_groups == 20
    assert row.exact_cardinality == 2000.0
    assert row.approximate_cardinality == 2190.0
    assert row.relative_error_mean == pytest.approx(0.095)
    assert row.relative_error_median == pytest.approx(0.09)
    assert row.relative_error_p95 == pytest.approx(0.18)
    assert row.relative_error_max == pytest.approx(0.19)


def test_global_error_summary(spark):
    left = spark.createDataFrame([(200,)], "distinct_count bigint")
    right = spark.createDataFrame([(190.0,)], "distinct_count double")
    row = summarize_errors(error_rows(left, right, [])).first()
    assert tuple(row) == pytest.approx((1, 200.0, 190.0, 0.05, 0.05, 0.05, 0.05))


def test_summaries_without_groups_are_zero(spark):
    empty = counts(spark, a=1).limit(0)
    assert tuple(summarize_errors(error_rows(empty, empty, ["group_id"])).first()) == (0,) + (0.0,) * 6
    assert tuple(summarize_exact(empty).first()) == (0,) + (0.0,) * 6


def test_summary_of_exact_counts(spark):
    row = summarize_exact(counts(spark, a=3, b=4)).first()
    assert tuple(row) == (2, 7.0, 7.0, 0.0, 0.0, 0.0, 0.0)


def test_error_join_reuses_the_partitioning(spark):
    """Two aggregates by the same columns are joined where they are."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df, query = synthetic(spark, rows=1000), ALL_QUERIES[1]
        plan = plan_of(error_rows(exact(df, query), approx(df, query), query.group_cols))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    tree = plan.split("\n\n")[0]
    # Duplicate removal and final count of the exact side, final count of the other side.
    assert tree.count("Exchange") == 3
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize(
    "samples,expected",
    [
        ([5], (5, 5.0, 5, 5, 0.0, 1)),
        ([1, 2], (2, 1.5, 1, 2, 0.5, 2)),
        ([9, 1, 5], (5, 5.0, 1, 9, math.sqrt(32 / 3), 3)),
        ([4, 1, 3, 2], (3, 2.5, 1, 4, math.sqrt(1.25), 4)),
    ],
)
def test_runtime_stats(spark, samples, expected):
    trials = trials_frame(spark, trial_rows("q", "m", samples))
    row = runtime_stats(trials).first()
    assert (row.query_name, row.method) == ("q", "m")
    assert tuple(row)[2:] == pytest.approx(expected)


def test_statistics_need_samples(spark):
    with pytest.raises(ValueError, match="at least one sample"):
        trial_rows("q", "m", [])
    with pytest.raises(ValueError, match="at least one sample"):
        trials_frame(spark, [])


@pytest.mark.parametrize("warmups,trials,builds,samples", [(1, 3, 4, 3), (0, 0, 1, 1), (-1, 2, 2, 2)])
def test_trials_build_the_frame_each_time(spark, warmups, trials, builds, samples):
    built = []

    def build():
        built.append(1)
        return spark.range(10)

    assert len(time_trials(build, warmups, trials)) == samples
    assert len(built) == builds


def test_evaluation_computes_the_aggregate(spark):
    """A failing key must fail the timed run, though a mere row count would skip it."""
    broken = spark.range(3).groupBy("id").agg(
        F.count_distinct(F.raise_error(F.lit("computed"))).alias("n")
    )
    assert broken.count() == 3
    with pytest.raises(Exception, match="computed"):
        evaluate(broken)


def test_costs(spark):
    assert one(spark, break_even_queries(F.lit(100), F.lit(30), F.lit(10))) == "5.00"
    assert one(spark, break_even_queries(F.lit(1), F.lit(9), F.lit(1))) == "0.13"
    assert one(spark, break_even_queries(F.lit(1), F.lit(9), F.lit(9))) == "never"
    assert one(spark, break_even_queries(F.lit(1), F.lit(8), F.lit(9))) == "never"
    assert one(spark, workload_exact_ms(5, F.lit(7))) == 35
    assert one(spark, workload_sketch_ms(10, F.lit(7), F.lit(2))) == 27
    assert one(spark, size_ratio(F.lit(10), F.lit(4))) == 2.5
    assert one(spark, size_ratio(F.lit(10), F.lit(0))) == 0.0


def test_report_doubles(spark):
    assert one(spark, report_double(F.lit(1.5))) == "1.50000000"
    assert one(spark, report_double(F.lit(0.123456785))) == "0.12345679"
    assert one(spark, report_double(F.lit(None).cast("double"))) is None
