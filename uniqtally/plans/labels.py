"""Names and notes that appear in result tables."""

EXACT = "exact_spark_sql"
APPROX = "spark_approx_count_distinct"
THETA_PARTITIONED = "datasketches_theta_partitioned"
HLL_PARTITIONED = "datasketches_hll_partitioned"
THETA_DIRECT = "datasketches_theta_udaf"
HLL_DIRECT = "datasketches_hll_udaf"

EXACT_NOTE = "ground truth"
EXACT_GROUPED_NOTE = "ground truth; exact_cardinality is sum of per-group cardinalities"
APPROX_NOTE = "Spark built-in HLL++ approximation"
THETA_PARTITIONED_NOTE = "Apache DataSketches Theta partition-level sketching; lgK={lgk}"
HLL_PARTITIONED_NOTE = "Apache DataSketches HLL partition-level sketching; lgK={lgk}"
THETA_DIRECT_NOTE = "Apache DataSketches Theta direct UDAF; lgK={lgk}"
HLL_DIRECT_NOTE = "Apache DataSketches HLL direct UDAF; lgK={lgk}"
MATERIALIZED_NOTE = (
    "Materialized sketches built once at {grain} and reused by merging stored sketch bytes"
)

METHOD_RESULTS_FILE = "benchmark_results.csv"
MATERIALIZATION_RESULTS_FILE = "materialization_results.csv"
MATRIX_SUMMARY_FILE = "benchmark_matrix_summary.csv"
