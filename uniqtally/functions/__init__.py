from uniqtally.functions.metrics import (
    break_even_queries,
    relative_error,
    report_double,
    size_ratio,
    workload_exact_ms,
    workload_sketch_ms,
)
from uniqtally.functions.sketches import (
    DEFAULT_LGK,
    HLL,
    SKETCH_KINDS,
    THETA,
    SketchKind,
    empty_sketch,
    hll_distinct,
    no_keys,
    shrink_hll,
    sketch_key,
    sketch_kind,
    theta_distinct,
)

__all__ = [
    "DEFAULT_LGK",
    "HLL",
    "SKETCH_KINDS",
    "THETA",
    "SketchKind",
    "break_even_queries",
    "empty_sketch",
    "hll_distinct",
    "no_keys",
    "relative_error",
    "report_double",
    "shrink_hll",
    "size_ratio",
    "sketch_key",
    "sketch_kind",
    "theta_distinct",
    "workload_exact_ms",
    "workload_sketch_ms",
]
