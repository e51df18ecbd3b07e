"""Distinct counts by group: exact, Spark's approximate count, and sketch estimates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uniqtally.functions.sketches import DEFAULT_LGK, SketchKind, sketch_kind
from uniqtally.operators.merging import (
    DISTINCT_COUNT,
    SKETCH_BYTES,
    estimates,
    merge_slot,
    merge_slots,
    sketch_by,
)

DEFAULT_RELATIVE_SD = 0.05


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


#: Slices of the map tasks in SQL text, which has no session to ask.
SQL_SLOTS = 200


@dataclass(frozen=True)
class DistinctQuery:
    """``COUNT(DISTINCT distinct_col)``, for the whole table or by group columns."""

    name: str
    group_cols: tuple[str, ...] = ()
    distinct_col: str = "distinct_key"

    def sql(self, table: str, aggregate: str) -> str:
        """SQL text of this query with any aggregate expression in place of the exact count."""
        groups = ", ".join(_quoted(name) for name in self.group_cols)
        selected = f"{groups}, " if groups else ""
        text = f"SELECT {selected}{aggregate} AS {DISTINCT_COUNT} FROM {table}"
        return f"{text} GROUP BY {groups}" if groups else text

    def exact_sql(self, table: str) -> str:
        return self.sql(table, f"COUNT(DISTINCT {_quoted(self.distinct_col)})")

    def approx_sql(self, table: str, relative_sd: float = DEFAULT_RELATIVE_SD) -> str:
        return self.sql(
            table, f"approx_count_distinct({_quoted(self.distinct_col)}, {relative_sd!r}D)"
        )

    def sketch_sql(
        self, table: str, kind: SketchKind | str, lgk: int = DEFAULT_LGK, slots: int = SQL_SLOTS
    ) -> str:
        """Sketches by group and slice of the map tasks, and above them their union by group."""
        kind = sketch_kind(kind)
        groups = "".join(f"{_quoted(name)}, " for name in self.group_cols)
        built = f"{kind.build_sql(_quoted(self.distinct_col), lgk)} AS {SKETCH_BYTES}"
        slot = f"pmod(spark_partition_id(), {slots})"
        inner = f"SELECT {groups}{built} FROM {table} GROUP BY {groups}{slot}"
        return self.sql(f"({inner})", kind.estimate_sql(SKETCH_BYTES, lgk))


# The four queries by name and grain.
ALL_QUERIES: tuple[DistinctQuery, ...] = (
    DistinctQuery("global_distinct"),
    DistinctQuery("grouped_distinct", ("group_id",)),
    DistinctQuery("time_window_distinct", ("date_bucket",)),
    DistinctQuery("multi_group_distinct", ("date_bucket", "group_id")),
)


def _aggregate(df: DataFrame, group_cols: Sequence[str], aggregate: Column) -> DataFrame:
    return df.groupBy(*group_cols).agg(aggregate.alias(DISTINCT_COUNT))


def exact(df: DataFrame, query: DistinctQuery) -> DataFrame:
    """Exact count. Spark removes duplicates by (group, key), so a hot group is spread by key."""
    return _aggregate(df, query.group_cols, F.count_distinct(query.distinct_col))


def approx(
    df: DataFrame, query: DistinctQuery, relative_sd: float = DEFAULT_RELATIVE_SD
) -> DataFrame:
    """Spark's built-in approximate count with a target relative standard deviation."""
    return _aggregate(
        df, query.group_cols, F.approx_count_distinct(query.distinct_col, relative_sd)
    )


def sketch(
    df: DataFrame,
    query: DistinctQuery,
    kind: SketchKind | str,
    lgk: int = DEFAULT_LGK,
    slots: int | None = None,
) -> DataFrame:
    """Sketch estimate: one sketch per map task and group, merged and read."""
    sketches = sketch_by(df, query.group_cols, query.distinct_col, kind, lgk, slots)
    return estimates(sketches, query.group_cols, kind)


def direct_sketch(
    df: DataFrame,
    query: DistinctQuery,
    kind: SketchKind | str,
    lgk: int = DEFAULT_LGK,
    slots: int | None = None,
) -> DataFrame:
    """Sketch estimate as one aggregate expression over sketches of slices of the map tasks.

    With one slot it is a single aggregate over the rows, whose sketches all meet in one task.
    """
    kind = sketch_kind(kind)
    slots = merge_slots(df.sparkSession) if slots is None else slots
    if slots <= 1:
        estimate = kind.estimate(kind.build(query.distinct_col, lgk))
        return _aggregate(df, query.group_cols, estimate)
    built = kind.build(query.distinct_col, lgk).alias(SKETCH_BYTES)
    sliced = df.groupBy(*query.group_cols, merge_slot(slots)).agg(built)
    return _aggregate(sliced, query.group_cols, kind.estimate(kind.merge(SKETCH_BYTES, lgk)))
