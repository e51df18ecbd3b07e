"""Distinct-count sketches as Column expressions over Spark's built-in sketch aggregates.

Everything here composes ``theta_*`` and ``hll_*`` functions that run inside the JVM with partial
aggregation, so one map task ships one sketch per group instead of its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

DEFAULT_LGK = 12


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def sketch_key(value: Column | str) -> Column:
    """A value as it enters a sketch: its text form. Nulls stay null and are skipped.

    Empty text is skipped by both sketches too, while an exact count counts it.
    """
    return _column(value).cast("string")


@dataclass(frozen=True)
class SketchKind:
    """One family of sketches: how to build, merge and read it."""

    name: str
    min_lgk: int
    max_lgk: int
    # Memory while updating: what a new sketch takes, and at most how much one more key adds.
    start_bytes: int
    key_bytes: int

    def check_lgk(self, lgk: int) -> int:
        if not self.min_lgk <= lgk <= self.max_lgk:
            raise ValueError(
                f"{self.name} sketches take lgk {self.min_lgk}..{self.max_lgk}, not {lgk}"
            )
        return lgk

    def build(self, value: Column | str, lgk: int = DEFAULT_LGK) -> Column:
        """Aggregate: one serialized sketch of all non-null values."""
        raise NotImplementedError

    def merge(self, sketch: Column | str, lgk: int = DEFAULT_LGK) -> Column:
        """Aggregate: union of serialized sketches, whose sizes may be mixed.

        A Theta union has size ``lgk`` at most; an HLL union has the smallest size among them.
        """
        raise NotImplementedError

    def merge_pair(self, left: Column | str, right: Column | str, lgk: int = DEFAULT_LGK) -> Column:
        """Scalar: union of two serialized sketches of one row."""
        raise NotImplementedError

    def estimate(self, sketch: Column | str) -> Column:
        """Scalar: estimated distinct count of a serialized sketch, as a double."""
        raise NotImplementedError

    def build_sql(self, expression: str, lgk: int = DEFAULT_LGK) -> str:
        """SQL text of the aggregate that builds a sketch of ``expression``."""
        raise NotImplementedError

    def estimate_sql(self, sketch: str, lgk: int = DEFAULT_LGK) -> str:
        """SQL text of the estimate of the union of the sketches in ``sketch``."""
        raise NotImplementedError

    def buffer_bytes(self, lgk: int = DEFAULT_LGK) -> int:
        """Upper bound of one full-grown sketch being updated in memory."""
        raise NotImplementedError


class _Theta(SketchKind):
    def build(self, value, lgk=DEFAULT_LGK):
        return F.theta_sketch_agg(sketch_key(value), self.check_lgk(lgk))

    def merge(self, sketch, lgk=DEFAULT_LGK):
        return F.theta_union_agg(_column(sketch), self.check_lgk(lgk))

    def merge_pair(self, left, right, lgk=DEFAULT_LGK):
        return F.theta_union(_column(left), _column(right), self.check_lgk(lgk))

    def estimate(self, sketch):
        return F.theta_sketch_estimate(_column(sketch)).cast("double")

    def build_sql(self, expression, lgk=DEFAULT_LGK):
        return f"theta_sketch_agg(CAST({expression} AS STRING), {self.check_lgk(lgk)})"

    def estimate_sql(self, sketch, lgk=DEFAULT_LGK):
        union = f"theta_union_agg({sketch}, {self.check_lgk(lgk)})"
        return f"CAST(theta_sketch_estimate({union}) AS DOUBLE)"

    def buffer_bytes(self, lgk=DEFAULT_LGK):
        # The hash table is kept at twice the nominal entry count, eight bytes per entry.
        return 16 << self.check_lgk(lgk)


class _Hll(SketchKind):
    def build(self, value, lgk=DEFAULT_LGK):
        return F.hll_sketch_agg(sketch_key(value), self.check_lgk(lgk))

    def merge(self, sketch, lgk=DEFAULT_LGK):
        self.check_lgk(lgk)
        return F.hll_union_agg(_column(sketch), True)

    def merge_pair(self, left, right, lgk=DEFAULT_LGK):
        self.check_lgk(lgk)
        return F.hll_union(_column(left), _column(right), True)

    def estimate(self, sketch):
        return F.hll_sketch_estimate(_column(sketch)).cast("double")

    def build_sql(self, expression, lgk=DEFAULT_LGK):
        return f"hll_sketch_agg(CAST({expression} AS STRING), {self.check_lgk(lgk)})"

    def estimate_sql(self, sketch, lgk=DEFAULT_LGK):
        self.check_lgk(lgk)
        return f"CAST(hll_sketch_estimate(hll_union_agg({sketch})) AS DOUBLE)"

    def buffer_bytes(self, lgk=DEFAULT_LGK):
        # One byte per register plus a fixed header.
        return (1 << self.check_lgk(lgk)) + 64


# A Theta hash table grows eightfold when it is half full, so 16 entries of 8 bytes per key.
THETA: SketchKind = _Theta("theta", 4, 26, start_bytes=2048, key_bytes=128)
# An HLL sketch starts as a list and then a set of 4-byte entries.
HLL: SketchKind = _Hll("hll", 4, 21, start_bytes=512, key_bytes=32)
SKETCH_KINDS: tuple[SketchKind, ...] = (THETA, HLL)


def sketch_kind(kind: SketchKind | str) -> SketchKind:
    if isinstance(kind, SketchKind):
        return kind
    for known in SKETCH_KINDS:
        if known.name == kind.lower():
            return known
    raise ValueError(f"Unsupported sketch kind: {kind}")


def theta_distinct(value: Column | str, lgk: int = DEFAULT_LGK) -> Column:
    """Aggregate: Theta estimate of the number of distinct non-null values, as a double."""
    return THETA.estimate(THETA.build(value, lgk))


def hll_distinct(value: Column | str, lgk: int = DEFAULT_LGK) -> Column:
    """Aggregate: HLL estimate of the number of distinct non-null values, as a double."""
    return HLL.estimate(HLL.build(value, lgk))


def empty_sketch(kind: SketchKind | str, lgk: int = DEFAULT_LGK) -> Column:
    """Scalar: the sketch of nothing, which leaves any sketch it is merged with as it is."""
    return SparkSession.active().range(1).agg(no_keys(kind, lgk)).scalar()


def no_keys(kind: SketchKind | str, lgk: int = DEFAULT_LGK) -> Column:
    """Aggregate: the sketch of nothing, whatever the rows."""
    return sketch_kind(kind).build(F.lit(None).cast("string"), lgk)


def shrink_hll(sketch: Column | str, empty: Column | str) -> Column:
    """Scalar: an HLL sketch lowered to the size of ``empty`` (a smaller one keeps its own size)."""
    return F.hll_union(_column(sketch), _column(empty), True)
