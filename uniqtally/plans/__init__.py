from uniqtally.plans.benchmark import run_benchmark
from uniqtally.plans.comparison import (
    Comparison,
    Method,
    compare,
    compare_materialized,
    comparison_methods,
    with_costs,
)
from uniqtally.plans.report import (
    MATERIALIZATION_RESULT_SCHEMA,
    MATRIX_SUMMARY_SCHEMA,
    METHOD_RESULT_SCHEMA,
    conform,
    matrix_summary,
    read_report,
    read_runs,
    report_text,
    write_materialization_results,
    write_matrix_summary,
    write_method_results,
    write_report,
)

__all__ = [
    "Comparison",
    "MATERIALIZATION_RESULT_SCHEMA",
    "MATRIX_SUMMARY_SCHEMA",
    "METHOD_RESULT_SCHEMA",
    "Method",
    "compare",
    "compare_materialized",
    "comparison_methods",
    "conform",
    "matrix_summary",
    "read_report",
    "read_runs",
    "report_text",
    "run_benchmark",
    "with_costs",
    "write_materialization_results",
    "write_matrix_summary",
    "write_method_results",
    "write_report",
]
