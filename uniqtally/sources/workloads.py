"""Generated workloads: hashed keys, groups and days over a range of ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tier:
    """Rows whose percentile is below ``below`` draw from ``1/divisor`` of the ids by a salt.

    The ids of all tiers start at 0, so a wider tier also holds those of a narrower one.
    """

    below: int
    salt: str
    divisor: int = 1


@dataclass(frozen=True)
class Workload:
    """How keys and groups are drawn, and the shape of this workload in the comparison matrix."""

    keys: tuple[Tier, ...]
    groups: tuple[Tier, ...]
    matrix_rows_per_key: int = 10
    matrix_groups: int = 100


# Hash salts, shares in percent, matrix shapes, text prefixes and first day.
WORKLOADS: dict[str, Workload] = {
    "uniform": Workload((Tier(100, "key"),), (Tier(100, "group"),)),
    "high_cardinality": Workload(
        (Tier(100, "high_key"),), (Tier(100, "group"),), matrix_rows_per_key=1
    ),
    "many_groups": Workload(
        (Tier(100, "key"),), (Tier(100, "many_groups"),), matrix_groups=1000
    ),
    "skewed": Workload(
        (Tier(70, "hot_key", 20), Tier(100, "cold_key")),
        (Tier(80, "hot_group", 20), Tier(95, "warm_group", 5), Tier(100, "cold_group")),
    ),
}
KEY_PERCENTILE_SALT = "key_bucket"
GROUP_PERCENTILE_SALT = "skew_bucket"
DAY_SALT = "day"
KEY_PREFIX = "key_"
GROUP_PREFIX = "group_"
FIRST_DAY = "2024-01-01"

ROWS_PER_SLICE = 10_000_000


def hashed(salt: str, domain: int) -> Column:
    """A number in ``0..domain-1`` that depends on the row id and the salt only."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(domain))


def drawn(tiers: tuple[Tier, ...], percentile_salt: str, domain: int) -> Column:
    """An id below ``domain`` by the tier that the row's percentile falls in."""
    percentile = hashed(percentile_salt, 100)
    *narrower, widest = tiers
    column = hashed(widest.salt, max(domain // widest.divisor, 1))
    for tier in reversed(narrower):
        column = F.when(
            percentile < tier.below, hashed(tier.salt, max(domain // tier.divisor, 1))
        ).otherwise(column)
    return column


def workload_named(name: str) -> Workload:
    known = WORKLOADS.get(name.lower().replace("-", "_"))
    if known is None:
        raise ValueError(f"Unsupported synthetic workload: {name}")
    return known


def workload_rows(
    ids: DataFrame,
    workload: str = "uniform",
    distinct: int = 100_000,
    groups: int = 100,
    days: int = 30,
) -> DataFrame:
    """Canonical rows for every ``id`` of a table, by a named workload."""
    shape = workload_named(workload)
    key = drawn(shape.keys, KEY_PERCENTILE_SALT, max(distinct, 1))
    group = drawn(shape.groups, GROUP_PERCENTILE_SALT, max(groups, 1))
    day = hashed(DAY_SALT, max(days, 1))
    return ids.select(
        F.col("id"),
        F.concat(F.lit(KEY_PREFIX), key.cast("string")).alias("distinct_key"),
        F.concat(F.lit(GROUP_PREFIX), group.cast("string")).alias("group_id"),
        F.date_add(F.to_date(F.lit(FIRST_DAY)), day.cast("int")).alias("date_bucket"),
    )


def synthetic(
    spark: SparkSession,
    workload: str = "uniform",
    rows: int = 1_000_000,
    distinct: int = 100_000,
    groups: int = 100,
    days: int = 30,
    partitions: int | None = None,
) -> DataFrame:
    """Generate ``rows`` canonical rows; the slices grow with the row count unless given."""
    if partitions is None:
        partitions = max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_SLICE))
    ids = spark.range(0, rows, 1, max(partitions, 1))
    return workload_rows(ids, workload, distinct, groups, days)


def matrix_parameters(workload: str, rows: int) -> tuple[int, int]:
    """Distinct keys and groups used for a workload of a given size in the comparison matrix."""
    shape = workload_named(workload)
    return max(rows // shape.matrix_rows_per_key, 1), shape.matrix_groups
