"""Several distinct estimates and plain measures by group, in one plan of two levels.

An aggregate of a bare sketch expression merges all sketches of a group in one task. Here every measure
says how it is taken over a slice of the map tasks and how slices are put together, so that all of
them go through the same two aggregates and a hot group is spread over as many tasks as there are
slots (see ``merging``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uniqtally.functions.sketches import DEFAULT_LGK, SketchKind, sketch_kind
from uniqtally.operators.merging import merge_slot, merge_slots


@dataclass(frozen=True)
class Measure:
    """``parts`` are aggregates of the rows of a slice. ``merge`` takes the columns that hold them and
    gives the aggregate over slices."""

    parts: tuple[Column, ...]
    merge: Callable[..., Column]


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def distinct_estimate(
    value: Column | str, kind: SketchKind | str = "theta", lgk: int = DEFAULT_LGK
) -> Measure:
    """Estimated number of distinct values that are not null, as a double."""
    kind = sketch_kind(kind)
    return Measure(
        (kind.build(value, lgk),), lambda sketch: kind.estimate(kind.merge(sketch, lgk))
    )


def row_count(where: Column | None = None) -> Measure:
    """Number of rows, or of those that fulfil a condition."""
    counted = F.count(F.lit(1)) if where is None else F.count_if(where)
    return Measure((counted,), lambda n: F.coalesce(F.sum(n), F.lit(0)).cast("long"))


def value_count(value: Column | str) -> Measure:
    """Number of rows whose value is not null."""
    return row_count(_column(value).isNotNull())


def total(value: Column | str) -> Measure:
    """Sum of the values that are not null; null if there are none."""
    return Measure((F.sum(_column(value)),), F.sum)


def lowest(value: Column | str) -> Measure:
    return Measure((F.min(_column(value)),), F.min)


def highest(value: Column | str) -> Measure:
    return Measure((F.max(_column(value)),), F.max)


def mean(value: Column | str) -> Measure:
    """Mean of the values that are not null, as a double; null if there are none."""
    value = _column(value)
    return Measure(
        (F.sum(value), F.count(value)),
        lambda sums, counts: (F.sum(sums) / F.nullif(F.sum(counts), F.lit(0))).cast("double"),
    )


def measures_by(
    df: DataFrame,
    group_cols: Sequence[str],
    measures: Mapping[str, Measure],
    slots: int | None = None,
) -> DataFrame:
    """Group columns and one column per measure; one row if there are no group columns.

    ``slots`` is the number of slices, by default one per shuffle partition of the session. Null groups
    form a group. The first level holds each group once per map task, the second once per slot.
    """
    clash = {name.lower() for name in group_cols} & {name.lower() for name in measures}
    if clash:
        raise ValueError(f"Measures named like group columns: {sorted(clash)}")
    slots = max(merge_slots(df.sparkSession) if slots is None else slots, 1)
    parts, merged = [], []
    for number, (name, measure) in enumerate(measures.items()):
        held = [f"_part_{number}_{i}" for i in range(len(measure.parts))]
        parts += [part.alias(column) for part, column in zip(measure.parts, held, strict=True)]
        merged.append(measure.merge(*map(F.col, held)).alias(name))
    grouped = df.groupBy(*group_cols, merge_slot(slots)).agg(*parts)
    return grouped.groupBy(*group_cols).agg(*merged)
