from uniqtally.sources.canonical import (
    DATE_BUCKET,
    DISTINCT_KEY,
    GROUP_ID,
    INPUT_VIEW,
    bucketed_layout,
    canonical_source,
    canonicalize,
    normalize_and_count,
    normalize_layout,
    register_input,
    table_name,
)
from uniqtally.sources.row_cap import cap_rows
from uniqtally.sources.storage import scratch_path, scratch_root, store_table, stored_bytes
from uniqtally.sources.workloads import WORKLOADS, matrix_parameters, synthetic, workload_rows
from uniqtally.sources.trip_records import load_trips, trips

__all__ = [
    "DATE_BUCKET",
    "DISTINCT_KEY",
    "GROUP_ID",
    "INPUT_VIEW",
    "WORKLOADS",
    "bucketed_layout",
    "canonical_source",
    "canonicalize",
    "cap_rows",
    "load_trips",
    "matrix_parameters",
    "normalize_and_count",
    "normalize_layout",
    "register_input",
    "scratch_path",
    "scratch_root",
    "store_table",
    "stored_bytes",
    "synthetic",
    "table_name",
    "trips",
    "workload_rows",
]
