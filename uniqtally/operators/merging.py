"""Building and merging sketches by group, in one or two levels.

In the plain plan every map task sends one sketch per group, and one task per group merges them all.
For a group found in every split of a very large table this is one merge of as many sketches as
there are splits. The two-level plan first merges within ``slots`` slices of the map tasks, in
parallel, and then merges the slices. A slot is taken from the task number, so each map task still
holds a single sketch per group, and which slot a sketch falls in does not change the union.

``slots=None`` takes as many slots as the session has shuffle partitions, for inputs of any size.
Pass 1 for an input of very many groups none of which is found in many splits; it saves the second
shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from uniqtally.functions.sketches import (
    DEFAULT_LGK,
    HLL,
    SketchKind,
    no_keys,
    shrink_hll,
    sketch_kind,
)

SKETCH_BYTES = "sketch_bytes"
DISTINCT_COUNT = "distinct_count"
SLOT = "_merge_slot"
EMPTY_BYTES = "_empty_bytes"

SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"
FALLBACK_THRESHOLD = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
MAX_INT = 2**31 - 1


def merge_slots(spark: SparkSession) -> int:
    """Slices of map tasks that are merged in parallel: one per shuffle partition."""
    return max(int(spark.conf.get(SHUFFLE_PARTITIONS)), 1)


def merge_slot(slots: int) -> Column:
    return F.pmod(F.spark_partition_id(), F.lit(slots)).alias(SLOT)


def sketch_by(
    df: DataFrame,
    group_cols: Sequence[str],
    value: str,
    kind: SketchKind | str,
    lgk: int = DEFAULT_LGK,
    slots: int | None = None,
) -> DataFrame:
    """Group columns and one sketch of ``value`` per group (one row if there are no columns)."""
    kind = sketch_kind(kind)
    slots = merge_slots(df.sparkSession) if slots is None else slots
    built = kind.build(value, lgk).alias(SKETCH_BYTES)
    if slots <= 1:
        return df.groupBy(*group_cols).agg(built)
    return (
        df.groupBy(*group_cols, merge_slot(slots))
        .agg(built)
        .groupBy(*group_cols)
        .agg(kind.merge(SKETCH_BYTES, lgk).alias(SKETCH_BYTES))
    )


def merge_by(
    table: DataFrame,
    group_cols: Sequence[str],
    kind: SketchKind | str,
    lgk: int = DEFAULT_LGK,
    slots: int | None = None,
) -> DataFrame:
    """Union of the stored sketches per group, of size ``lgk`` at most.

    Stored sizes may be mixed. A Theta union is trimmed to ``lgk``. An HLL union takes the smallest
    size among its sketches, and if that is larger than ``lgk``, the one union per group is lowered;
    the stored rows themselves go into the aggregate as they are.
    """
    kind = sketch_kind(kind)
    slots = merge_slots(table.sparkSession) if slots is None else slots
    merged = kind.merge(SKETCH_BYTES, lgk).alias(SKETCH_BYTES)
    if slots > 1:
        table = table.groupBy(*group_cols, merge_slot(slots)).agg(merged)
    if kind is not HLL:
        return table.groupBy(*group_cols).agg(merged)
    # The empty sketch of the wanted size is an aggregate of the same plan, not a job of its own.
    both = table.groupBy(*group_cols).agg(merged, no_keys(HLL, lgk).alias(EMPTY_BYTES))
    return both.select(*group_cols, shrink_hll(SKETCH_BYTES, EMPTY_BYTES).alias(SKETCH_BYTES))


def estimates(sketches: DataFrame, group_cols: Sequence[str], kind: SketchKind | str) -> DataFrame:
    """Group columns and the estimate of each sketch."""
    estimate = sketch_kind(kind).estimate(SKETCH_BYTES)
    return sketches.select(*group_cols, estimate.alias(DISTINCT_COUNT))


def hash_groups_within(kind: SketchKind | str, lgk: int, task_bytes: int) -> int:
    """How many groups a task may hold in a hash map if all its sketches are full-grown."""
    return max(task_bytes // sketch_kind(kind).buffer_bytes(lgk), 1)


@contextmanager
def many_groups(spark: SparkSession, kind: SketchKind | str, lgk: int, task_bytes: int):
    """Let a task hash more groups before it turns to sorting, within ``task_bytes``.

    Spark switches a sketch aggregate to sorting all further rows after 128 groups per task, which
    costs about as much as an exact count. What a task can spare is a share of the executor's memory
    by its cores, which the caller knows. The setting belongs to the session and is read when a query
    starts: run the action inside the block, and no other query of the session meanwhile. A larger
    setting of the session is kept.
    """
    before = spark.conf.get(FALLBACK_THRESHOLD)
    groups = max(int(before), hash_groups_within(kind, lgk, task_bytes))
    spark.conf.set(FALLBACK_THRESHOLD, str(min(groups, MAX_INT)))
    try:
        yield
    finally:
        spark.conf.set(FALLBACK_THRESHOLD, before)
