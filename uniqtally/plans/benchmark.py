"""The whole run: load, store once, compare all methods, and report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from uniqtally.functions.sketches import DEFAULT_LGK
from uniqtally.operators.distinct import DEFAULT_RELATIVE_SD
from uniqtally.plans.comparison import compare, compare_materialized
from uniqtally.plans.report import (
    MATERIALIZATION_RESULT_SCHEMA,
    METHOD_RESULT_SCHEMA,
    read_report,
    write_materialization_results,
    write_method_results,
)
from uniqtally.sources.canonical import canonical_source, normalize_and_count, register_input


def run_benchmark(
    spark: SparkSession,
    run_dir: str,
    dataset: str = "synthetic",
    input_path: str = "",
    max_rows: int = 0,
    relative_sd: float = DEFAULT_RELATIVE_SD,
    theta_lgk: int = DEFAULT_LGK,
    hll_lgk: int = DEFAULT_LGK,
    warmups: int = 1,
    trials: int = 3,
    cache_input: bool = False,
    cache_sketch_table: bool = False,
    include_direct: bool = True,
    task_bytes: int | None = None,
    slots: int | None = None,
    **workload,
) -> tuple[DataFrame, DataFrame]:
    """Write input, sketch tables and both result files below ``run_dir``; return the results.

    ``task_bytes`` and ``slots`` go to the methods that merge sketches (see ``compare``).
    """
    raw_path = f"{run_dir}/data/{dataset.lower()}.parquet"
    source = canonical_source(spark, dataset, input_path, max_rows, **workload)
    stored, rows = normalize_and_count(source, raw_path)
    table, input_rows = register_input(stored, cache_input, rows=rows)
    sizes = {"theta_lgk": theta_lgk, "hll_lgk": hll_lgk, "warmups": warmups, "trials": trials}
    sizes |= {"task_bytes": task_bytes, "slots": slots}
    try:
        comparison = compare(
            table,
            dataset,
            relative_sd=relative_sd,
            include_direct=include_direct,
            store=f"{run_dir}/counts",
            input_rows=input_rows,
            **sizes,
        )
        methods_path = write_method_results(comparison.results, run_dir)
        materialized = compare_materialized(
            table,
            comparison,
            dataset,
            raw_path,
            cache_sketch_table=cache_sketch_table,
            store=f"{run_dir}/materialized_sketches",
            **sizes,
        )
        materialized_path = write_materialization_results(materialized, run_dir)
    finally:
        if cache_input:
            table.unpersist()
    return (
        read_report(spark, methods_path, METHOD_RESULT_SCHEMA),
        read_report(spark, materialized_path, MATERIALIZATION_RESULT_SCHEMA),
    )
