import csv
from pathlib import Path

import pytest
from plan_text import plan_of
from pyspark.sql import functions as F

from uniqtally.operators import ALL_QUERIES, runtime_stats, trials_frame
from uniqtally.plans import (
    MATERIALIZATION_RESULT_SCHEMA,
    MATRIX_SUMMARY_SCHEMA,
    METHOD_RESULT_SCHEMA,
    compare,
    matrix_summary,
    read_report,
    read_runs,
    run_benchmark,
    write_matrix_summary,
    write_report,
)
from uniqtally.sources import synthetic


def csv_rows(path):
    part = next(Path(path).glob("part-*.csv"))
    with part.open(newline="") as handle:
        return list(csv.DictReader(handle))


def test_schemas():
    assert len(METHOD_RESULT_SCHEMA) == 19
    assert len(MATERIALIZATION_RESULT_SCHEMA) == 38
    assert len(MATRIX_SUMMARY_SCHEMA) == 24


def test_csv_text(spark, tmp_path):
    rows = [("a,b", 1.5, 7, 'q"q'), (" padded ", None, None, "plain"), ("line\nbreak", 2e-9, 1, "")]
    df = spark.createDataFrame(rows, "dataset string, error double, n bigint, notes string")
    path = write_report(df.coalesce(1), str(tmp_path / "report"))
    text = next(Path(path).glob("part-*.csv")).read_text()
    assert text == (
        "dataset,error,n,notes\n"
        '"a,b",1.50000000,7,"q""q"\n'
        " padded ,,,plain\n"
        '"line\nbreak",0.00000000,1,\n'
    )


def test_csv_round_trip(spark, tmp_path):
    rows = [("a,b", 1.5, 7, 'q"q'), ("c", None, None, "two\nlines"), ("#d", 0.0, 0, "back\\slash")]
    df = spark.createDataFrame(rows, "dataset string, error double, n bigint, notes string")
    back = read_report(spark, write_report(df, str(tmp_path / "report")), df.schema)
    assert sorted(tuple(row) for row in back.collect()) == sorted(rows)


def test_reading_a_wrong_header_fails(spark, tmp_path):
    (tmp_path / "wrong.csv").write_text("dataset,method\na,b\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_report(spark, str(tmp_path / "wrong.csv"), METHOD_RESULT_SCHEMA).collect()


METHODS = "run_dir string, query_name string, method string, num_groups bigint, runtime_ms bigint"
STORED = (
    "run_dir string, query_name string, sketch_type string, num_sketch_rows bigint, "
    "exact_query_time_ms bigint, sketch_query_time_ms bigint, build_time_ms bigint, "
    "raw_to_sketch_size_ratio double, relative_error_median double, relative_error_p95 double, "
    "break_even_queries string"
)
RUNS = "dataset string, workload string, rows bigint, regime string, run_dir string"


def test_matrix_alignment(spark):
    runs = [("synthetic", "uniform", 10, "cold", run) for run in ("r1", "r2", "r3", "r4")]
    methods = [
        ("r1", "b", "exact_spark_sql", 4, 40),
        ("r1", "b", "spark_approx_count_distinct", 4, 30),
        ("r1", "b", "datasketches_theta_partitioned", 4, 20),
        ("r1", "b", "datasketches_hll_udaf", 4, 1),
        ("r2", "a", "exact_spark_sql", 1, 10),
        ("r3", "a", "exact_spark_sql", 1, 10),
    ]
    stored = [
        ("r1", "b", "hll", 9, 44, 3, 5, 1.5, 0.1, 0.2, "never"),
        ("r1", "b", "theta", 9, 45, 2, 6, 2.5, 0.3, 0.4, "1.00"),
        ("r1", "a", "hll", 9, 33, 3, 5, 1.5, 0.1, 0.2, "2.00"),
        ("r1", "c", "theta", 9, 34, 3, 5, 1.5, 0.1, 0.2, "2.00"),
        ("r2", "a", "theta", 9, 11, 3, 5, 1.5, 0.1, 0.2, "2.00"),
        ("r4", "a", "theta", 9, 11, 3, 5, 1.5, 0.1, 0.2, "2.00"),
    ]
    summary = matrix_summary(
        spark.createDataFrame(runs, RUNS),
        spark.createDataFrame(methods, METHODS),
        spark.createDataFrame(stored, STORED),
    )
    assert summary.columns == MATRIX_SUMMARY_SCHEMA.names
    rows = summary.collect()
    # Runs with only one of the two tables are left out.
    assert [(row.run_dir, row.query_name) for row in rows] == [
        ("r1", "a"), ("r1", "b"), ("r1", "c"), ("r2", "a"),
    ]
    only_hll, full, only_theta, second = rows
    assert (full.num_groups, full.exact_ms, full.exact_materialization_baseline_ms) == (4, 40, 44)
    assert (full.spark_approx_ms, full.theta_raw_ms, full.hll_raw_ms) == (30, 20, None)
    assert (full.theta_materialized_query_ms, full.hll_materialized_query_ms) == (2, 3)
    assert (full.theta_break_even_queries, full.hll_break_even_queries) == ("1.00", "never")
    assert (only_hll.num_groups, only_hll.exact_ms) == (9, 33)
    assert only_hll.exact_materialization_baseline_ms == 33 and only_hll.theta_build_ms is None
    assert (only_theta.num_groups, only_theta.exact_ms) == (None, None)
    assert only_theta.exact_materialization_baseline_ms == 34
    assert (second.exact_ms, second.exact_materialization_baseline_ms) == (10, 11)


def test_comparison_survives_a_hidden_cache(spark):
    """Exact trials never read an answer that was kept from an earlier run."""
    df = synthetic(spark, rows=2000, distinct=100, groups=3, days=2)
    result = compare(df, "d", ALL_QUERIES[:2], trials=2, include_direct=False, view="compared")
    assert "InMemoryTableScan" not in plan_of(result.exact_counts(ALL_QUERIES[1]))
    assert result.input_rows == 2000
    assert len(result.trials) == 2 * 4 * 2
    stats = runtime_stats(trials_frame(spark, result.trials))
    joined = result.results.join(
        stats.select("query_name", "method", F.col("runtime_ms").alias("again")),
        ["query_name", "method"],
    )
    assert joined.where(F.col("again") == F.col("runtime_ms")).count() == 8


@pytest.mark.parametrize("rows,exact_groups", [([("a", None), ("b", None)], 1), ([], 0)])
def test_comparison_without_common_groups(spark, rows, exact_groups):
    """Null groups are in the exact summary only; every method still has its row."""
    df = spark.createDataFrame(rows, "distinct_key string, group_id string")
    results = compare(df, "d", ALL_QUERIES[1:2], trials=1, view="no_groups").results.collect()
    assert [row.num_groups for row in results] == [exact_groups, 0, 0, 0, 0, 0]
    assert results[0].exact_cardinality == len(rows)
    assert all(row.approximate_cardinality == row.relative_error_max == 0.0 for row in results[1:])
    assert [row.relative_sd for row in results] == [None, 0.05, None, None, None, None]


def test_whole_run_and_matrix(spark, tmp_path):
    workload = {"rows": 3000, "distinct": 200, "groups": 5, "days": 3, "partitions": 3}
    methods, stored = run_benchmark(
        spark, str(tmp_path / "run1"), trials=2, cache_input=True, cache_sketch_table=True, **workload
    )
    assert methods.count() == 24 and stored.count() == 8
    text = csv_rows(tmp_path / "run1" / "benchmark_results.csv")
    assert list(text[0]) == METHOD_RESULT_SCHEMA.names
    assert [row["query_name"] for row in text[::6]] == [query.name for query in ALL_QUERIES]
    assert [row["method"] for row in text[:6]] == [
        "exact_spark_sql",
        "spark_approx_count_distinct",
        "datasketches_theta_partitioned",
        "datasketches_hll_partitioned",
        "datasketches_theta_udaf",
        "datasketches_hll_udaf",
    ]
    first = text[0]
    assert first["input_rows"] == "3000" and first["exact_cardinality"] == "200.00000000"
    assert first["relative_sd"] == "" and text[1]["relative_sd"] == "0.05000000"
    assert first["notes"] == "ground truth"
    assert text[6]["notes"].endswith("sum of per-group cardinalities")
    assert text[2]["notes"].endswith("lgK=12")
    assert {row["runtime_trials"] for row in text} == {"2"}

    text = csv_rows(tmp_path / "run1" / "materialization_results.csv")
    assert list(text[0]) == MATERIALIZATION_RESULT_SCHEMA.names
    assert [row["sketch_type"] for row in text] == ["theta"] * 4 + ["hll"] * 4
    assert {row["num_sketch_rows"] for row in text} == {"15"}
    assert {row["materialization_group"] for row in text} == {"date_bucket+group_id"}
    for row in text:
        build, exact_ms, sketch_ms = (
            int(row[name])
            for name in ("build_time_ms", "exact_query_time_ms", "sketch_query_time_ms")
        )
        assert int(row["workload_5_exact_ms"]) == 5 * exact_ms
        assert int(row["workload_10_sketch_ms"]) == build + 10 * sketch_ms
        assert (row["break_even_queries"] == "never") == (exact_ms <= sketch_ms)
        ratio = int(row["raw_input_size_bytes"]) / int(row["sketch_table_size_bytes"])
        assert float(row["raw_to_sketch_size_ratio"]) == pytest.approx(ratio, abs=1e-6)
        assert row["relative_error_max"] == "0.00000000" or row["sketch_type"] == "hll"

    # Exact times in both files are the same measurement.
    exact_ms = {
        row.query_name: row.runtime_ms
        for row in methods.where("method = 'exact_spark_sql'").collect()
    }
    assert all(row.exact_query_time_ms == exact_ms[row.query_name] for row in stored.collect())

    run_benchmark(spark, str(tmp_path / "run2"), trials=1, warmups=0, include_direct=False, **workload)
    runs = spark.createDataFrame(
        [("synthetic", "uniform", 3000, "warm", "run1"), ("synthetic", "uniform", 3000, "cold", "run2")],
        RUNS,
    )
    summary = matrix_summary(
        runs,
        read_runs(spark, str(tmp_path), "benchmark_results.csv", METHOD_RESULT_SCHEMA),
        read_runs(
            spark, str(tmp_path), "materialization_results.csv", MATERIALIZATION_RESULT_SCHEMA
        ),
    )
    write_matrix_summary(summary, str(tmp_path))
    text = csv_rows(tmp_path / "benchmark_matrix_summary.csv")
    assert list(text[0]) == MATRIX_SUMMARY_SCHEMA.names
    assert [(row["run_dir"], row["query_name"]) for row in text] == [
        (run, name)
        for run in ("run1", "run2")
        for name in sorted(query.name for query in ALL_QUERIES)
    ]
    assert all(value != "" for row in text for value in row.values())


def test_runs_from_single_file_results(spark, tmp_path):
    """A result file may also be a plain file in the run's folder."""
    run = tmp_path / "20240101_000000"
    run.mkdir()
    line = "synthetic,global_distinct,exact_spark_sql,5,1,3.0,3.0,9,9.0,9,9,0.0,1,0,0,0,0,,ground truth"
    (run / "benchmark_results.csv").write_text(",".join(METHOD_RESULT_SCHEMA.names) + "\n" + line)
    row = read_runs(spark, str(tmp_path), "benchmark_results.csv", METHOD_RESULT_SCHEMA).first()
    assert (row.run_dir, row.runtime_ms, row.relative_sd) == ("20240101_000000", 9, None)


def test_taxi_run(spark, tmp_path):
    trips_path = str(tmp_path / "trips")
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(
        F.col("l_shipdate").alias("tpep_pickup_datetime"),
        F.col("l_suppkey").alias("PULocationID"),
        F.col("l_partkey").cast("double").alias("DOLocationID"),
    ).write.parquet(trips_path)
    methods, stored = run_benchmark(
        spark,
        str(tmp_path / "run"),
        dataset="Taxi",
        input_path=trips_path,
        max_rows=1500,
        trials=1,
        include_direct=False,
    )
    assert {row.input_rows for row in methods.collect()} == {1500}
    # The stored input is found whatever the case of the dataset name.
    assert all(row.raw_input_size_bytes > 0 for row in stored.collect())
