"""Stored sketches: build once at a fine grain, answer coarser questions by merging."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import AbstractContextManager, nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uniqtally.functions.metrics import size_ratio
from uniqtally.functions.sketches import DEFAULT_LGK, SketchKind
from uniqtally.operators.merging import (
    SKETCH_BYTES,
    estimates,
    many_groups,
    merge_by,
    sketch_by,
)
from uniqtally.sources.storage import (
    is_any_of,
    replace_partitions,
    store_table,
    stored_bytes,
)

# Fixed value: the finest grain that the four queries need.
MATERIALIZED_GRAIN: tuple[str, ...] = ("date_bucket", "group_id")


def build_sketch_table(
    df: DataFrame,
    group_cols: Sequence[str] = MATERIALIZED_GRAIN,
    distinct_col: str = "distinct_key",
    kind: SketchKind | str = "theta",
    lgk: int = DEFAULT_LGK,
    slots: int | None = None,
) -> DataFrame:
    """Group columns and ``sketch_bytes``, one row per group."""
    if not group_cols:
        raise ValueError("A sketch table needs at least one group column")
    return sketch_by(df, group_cols, distinct_col, kind, lgk, slots)


def write_sketch_table(
    table: DataFrame, path: str, partition_cols: Sequence[str] = ()
) -> DataFrame:
    """Store a sketch table as Parquet, in a folder per value of ``partition_cols``; scan it."""
    return store_table(table, path, partition_cols)


def store_sketch_table(
    df: DataFrame,
    path: str,
    group_cols: Sequence[str] = MATERIALIZED_GRAIN,
    distinct_col: str = "distinct_key",
    kind: SketchKind | str = "theta",
    lgk: int = DEFAULT_LGK,
    task_bytes: int | None = None,
    slots: int | None = None,
    partition_cols: Sequence[str] = (),
) -> DataFrame:
    """Build a sketch table and store it.

    With ``task_bytes``, a task may spend so much on the sketches it builds (see ``many_groups``).
    ``slots=1`` saves the second shuffle where no group is found in many splits. With
    ``partition_cols`` the files lie in a folder per value, so that queries over some values read only
    those, and ``rebuild_partitions`` can replace them alone.
    """
    table = build_sketch_table(df, group_cols, distinct_col, kind, lgk, slots)
    with _room(df.sparkSession, kind, lgk, task_bytes):
        return write_sketch_table(table, path, partition_cols)


def _room(
    spark: SparkSession, kind: SketchKind | str, lgk: int, task_bytes: int | None
) -> AbstractContextManager:
    return nullcontext() if task_bytes is None else many_groups(spark, kind, lgk, task_bytes)


def rebuild_partitions(
    df: DataFrame,
    path: str,
    values: Sequence,
    partition_col: str = "date_bucket",
    group_cols: Sequence[str] = MATERIALIZED_GRAIN,
    distinct_col: str = "distinct_key",
    kind: SketchKind | str = "theta",
    lgk: int = DEFAULT_LGK,
    slots: int | None = None,
    task_bytes: int | None = None,
) -> DataFrame:
    """Build the sketches of some partitions (None names the one of nulls) anew from ``df``.

    The table in ``path`` must be partitioned by ``partition_col`` alone. Files of other partitions
    are neither read nor written. A named partition without rows in ``df`` is removed.
    """
    spark = df.sparkSession
    chosen = df.where(is_any_of(partition_col, values))
    table = build_sketch_table(chosen, group_cols, distinct_col, kind, lgk, slots)
    with _room(spark, kind, lgk, task_bytes):
        replace_partitions(table, path, partition_col, values)
    return read_sketch_table(spark, path, schema=table.schema)


def read_sketch_table(
    spark: SparkSession, path: str, cache: bool = False, schema: T.StructType | None = None
) -> DataFrame:
    """A stored table, partitioned or not. ``schema`` saves looking at files and partition names."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    table = reader.parquet(path)
    return table.cache() if cache else table


def rollup(
    table: DataFrame,
    target_cols: Sequence[str],
    kind: SketchKind | str,
    lgk: int = DEFAULT_LGK,
    slots: int | None = None,
) -> DataFrame:
    """Estimates at any subset of the stored grain; no columns means the whole table."""
    return estimates(merge_by(table, target_cols, kind, lgk, slots), target_cols, kind)


def sketch_sizes(table: DataFrame) -> DataFrame:
    """One row: number of stored sketches and their mean length in bytes."""
    return table.agg(
        F.count(F.lit(1)).alias("num_sketch_rows"),
        F.coalesce(F.avg(F.length(SKETCH_BYTES).cast("double")), F.lit(0.0)).alias(
            "average_sketch_size_bytes"
        ),
    )


def table_stats(spark: SparkSession, table: DataFrame, path: str, raw_path: str) -> DataFrame:
    """One row: sketch rows and mean length, stored bytes of both tables, and their ratio."""
    sketch_bytes = stored_bytes(spark, path).scalar()
    raw_bytes = stored_bytes(spark, raw_path).scalar()
    return (
        sketch_sizes(table)
        .select(
            "*",
            sketch_bytes.alias("sketch_table_size_bytes"),
            raw_bytes.alias("raw_input_size_bytes"),
        )
        .withColumn(
            "raw_to_sketch_size_ratio",
            size_ratio(F.col("raw_input_size_bytes"), F.col("sketch_table_size_bytes")),
        )
    )
