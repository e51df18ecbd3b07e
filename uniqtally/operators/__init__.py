from uniqtally.operators.accuracy import error_rows, summarize_errors, summarize_exact
from uniqtally.operators.distinct import (
    ALL_QUERIES,
    DEFAULT_RELATIVE_SD,
    DistinctQuery,
    approx,
    direct_sketch,
    exact,
    sketch,
)
from uniqtally.operators.measures import (
    Measure,
    distinct_estimate,
    highest,
    lowest,
    mean,
    measures_by,
    row_count,
    total,
    value_count,
)
from uniqtally.operators.merging import (
    estimates,
    hash_groups_within,
    many_groups,
    merge_by,
    merge_slots,
    sketch_by,
)
from uniqtally.operators.runtime import (
    evaluate,
    runtime_stats,
    time_trials,
    trial_rows,
    trials_frame,
)
from uniqtally.operators.sketch_table import (
    MATERIALIZED_GRAIN,
    build_sketch_table,
    read_sketch_table,
    rebuild_partitions,
    rollup,
    sketch_sizes,
    store_sketch_table,
    table_stats,
    write_sketch_table,
)

__all__ = [
    "ALL_QUERIES",
    "DEFAULT_RELATIVE_SD",
    "MATERIALIZED_GRAIN",
    "DistinctQuery",
    "Measure",
    "approx",
    "build_sketch_table",
    "direct_sketch",
    "distinct_estimate",
    "error_rows",
    "estimates",
    "evaluate",
    "exact",
    "hash_groups_within",
    "highest",
    "lowest",
    "many_groups",
    "mean",
    "measures_by",
    "merge_by",
    "merge_slots",
    "read_sketch_table",
    "rebuild_partitions",
    "rollup",
    "row_count",
    "runtime_stats",
    "sketch",
    "sketch_by",
    "sketch_sizes",
    "store_sketch_table",
    "summarize_errors",
    "summarize_exact",
    "table_stats",
    "time_trials",
    "total",
    "trial_rows",
    "trials_frame",
    "value_count",
    "write_sketch_table",
]
