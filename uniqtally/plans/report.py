"""Result tables: schemas, CSV files, and the summary over many runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uniqtally.functions.metrics import report_double
from uniqtally.plans import labels


COLUMN_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
}


def _schema(columns: str) -> T.StructType:
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, COLUMN_TYPES[kind]) for name, kind in pairs])


# Columns of the three result tables, in order.
METHOD_RESULT_SCHEMA = _schema(
    """dataset string, query_name string, method string, input_rows bigint, num_groups bigint,
    exact_cardinality double, approximate_cardinality double, runtime_ms bigint,
    runtime_mean_ms double, runtime_min_ms bigint, runtime_max_ms bigint, runtime_stddev_ms double,
    runtime_trials int, relative_error_mean double, relative_error_median double,
    relative_error_p95 double, relative_error_max double, relative_sd double, notes string"""
)
MATERIALIZATION_RESULT_SCHEMA = _schema(
    """dataset string, sketch_type string, materialization_group string, query_name string,
    input_rows bigint, num_sketch_rows bigint, exact_cardinality double,
    approximate_cardinality double, build_time_ms bigint, build_mean_ms double, build_min_ms bigint,
    build_max_ms bigint, build_stddev_ms double, exact_query_time_ms bigint,
    exact_query_mean_ms double, exact_query_min_ms bigint, exact_query_max_ms bigint,
    exact_query_stddev_ms double, sketch_query_time_ms bigint, sketch_query_mean_ms double,
    sketch_query_min_ms bigint, sketch_query_max_ms bigint, sketch_query_stddev_ms double,
    sketch_table_size_bytes bigint, average_sketch_size_bytes double, raw_input_size_bytes bigint,
    raw_to_sketch_size_ratio double, workload_5_exact_ms bigint, workload_5_sketch_ms bigint,
    workload_10_exact_ms bigint, workload_10_sketch_ms bigint, runtime_trials int,
    relative_error_mean double, relative_error_median double, relative_error_p95 double,
    relative_error_max double, break_even_queries string, notes string"""
)
MATRIX_SUMMARY_SCHEMA = _schema(
    """dataset string, workload string, rows bigint, regime string, run_dir string,
    query_name string, num_groups bigint, exact_ms bigint,
    exact_materialization_baseline_ms bigint, spark_approx_ms bigint, theta_raw_ms bigint,
    hll_raw_ms bigint, theta_materialized_query_ms bigint, hll_materialized_query_ms bigint,
    theta_build_ms bigint, hll_build_ms bigint, theta_size_ratio double, hll_size_ratio double,
    theta_median_error double, hll_median_error double, theta_p95_error double,
    hll_p95_error double, theta_break_even_queries string, hll_break_even_queries string"""
)

RUN_KEYS = ["run_dir", "query_name"]
CSV_QUOTING = {"header": True, "quote": '"', "escape": '"'}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a schema, in its order and types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def report_text(df: DataFrame) -> DataFrame:
    """All columns as they are written: doubles with eight decimals, other types by their text."""
    return df.select(
        *[
            (
                report_double(F.col(field.name))
                if isinstance(field.dataType, T.DoubleType)
                else F.col(field.name).cast("string")
            ).alias(field.name)
            for field in df.schema
        ]
    )


def write_report(df: DataFrame, path: str) -> str:
    """Write a result table as one CSV file with a header, below the folder ``path``.

    A result table has one row per run, query and method, so one task can write it; what made
    the table keeps its own tasks.
    """
    (
        report_text(df)
        .repartition(1)
        .write.mode("overwrite")
        .options(**CSV_QUOTING, nullValue="", emptyValue="")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path


def write_method_results(results: DataFrame, run_dir: str) -> str:
    return write_report(
        conform(results, METHOD_RESULT_SCHEMA), f"{run_dir}/{labels.METHOD_RESULTS_FILE}"
    )


def write_materialization_results(results: DataFrame, run_dir: str) -> str:
    return write_report(
        conform(results, MATERIALIZATION_RESULT_SCHEMA),
        f"{run_dir}/{labels.MATERIALIZATION_RESULTS_FILE}",
    )


def write_matrix_summary(summary: DataFrame, root: str) -> str:
    return write_report(
        conform(summary, MATRIX_SUMMARY_SCHEMA), f"{root}/{labels.MATRIX_SUMMARY_FILE}"
    )


def read_report(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Scan result CSV files with a header; notes may hold line breaks."""
    reader = spark.read.schema(schema).options(**CSV_QUOTING, enforceSchema=False, multiLine=True)
    return reader.csv(path)


def _run_dir(file_name: str) -> Column:
    """Name of the folder that holds the result file (or the folder of its parts)."""
    before = F.substring_index(F.col("_metadata.file_path"), f"/{file_name}", 1)
    return F.substring_index(before, "/", -1)


def read_runs(spark: SparkSession, root: str, file_name: str, schema: T.StructType) -> DataFrame:
    """One result table of all runs below ``root``, with the name of each run's folder."""
    rows = read_report(spark, f"{root}/*/{file_name}", schema)
    return rows.select(_run_dir(file_name).alias("run_dir"), *schema.names)


def _per_query(rows: DataFrame, kind: str, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per run and query; each wanted column is one figure of one method."""
    return rows.groupBy(*RUN_KEYS).agg(
        *[
            F.max(F.when(F.col(kind) == value, F.col(figure))).alias(name)
            for name, (value, figure) in wanted.items()
        ]
    )


def matrix_summary(runs: DataFrame, methods: DataFrame, materialized: DataFrame) -> DataFrame:
    """One row per run and query, with the figures of all methods side by side.

    ``runs`` has ``dataset, workload, rows, regime, run_dir``; the other two are result tables with
    a ``run_dir``. Runs that lack one of them are left out. A missing figure is null, but the group
    count, the exact time and its baseline fall back on the other table; that group count is then
    the number of stored sketches, which is finer than the query's own groups.
    """
    by_method = _per_query(
        methods,
        "method",
        {
            "exact_groups": (labels.EXACT, "num_groups"),
            "measured_exact_ms": (labels.EXACT, "runtime_ms"),
            "spark_approx_ms": (labels.APPROX, "runtime_ms"),
            "theta_raw_ms": (labels.THETA_PARTITIONED, "runtime_ms"),
            "hll_raw_ms": (labels.HLL_PARTITIONED, "runtime_ms"),
        },
    )
    figures = {
        "sketch_rows": "num_sketch_rows",
        "baseline_ms": "exact_query_time_ms",
        "materialized_query_ms": "sketch_query_time_ms",
        "build_ms": "build_time_ms",
        "size_ratio": "raw_to_sketch_size_ratio",
        "median_error": "relative_error_median",
        "p95_error": "relative_error_p95",
        "break_even_queries": "break_even_queries",
    }
    by_sketch = _per_query(
        materialized,
        "sketch_type",
        {
            f"{kind}_{name}": (kind, figure)
            for kind in ("theta", "hll")
            for name, figure in figures.items()
        },
    )
    run = Window.partitionBy("run_dir")
    aligned = (
        by_method.withColumn("measured", F.lit(True))
        .join(by_sketch.withColumn("stored", F.lit(True)), RUN_KEYS, "full_outer")
        .withColumn("measured", F.max("measured").over(run))
        .withColumn("stored", F.max("stored").over(run))
        .where(F.col("measured") & F.col("stored"))
        .withColumn("num_groups", F.coalesce("exact_groups", "hll_sketch_rows"))
        .withColumn("exact_ms", F.coalesce("measured_exact_ms", "hll_baseline_ms"))
        .withColumn(
            "exact_materialization_baseline_ms",
            F.coalesce("hll_baseline_ms", "theta_baseline_ms"),
        )
    )
    return conform(runs.join(aligned, "run_dir"), MATRIX_SUMMARY_SCHEMA).orderBy(*RUN_KEYS)
