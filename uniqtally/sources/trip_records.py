"""Trip records as canonical rows: routes as keys, pick-up places as groups."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uniqtally.sources.row_cap import FILE, FILE_POSITION, ROW, cap_rows
from uniqtally.sources.storage import scratch_path, store_table

# Raw column names and text prefixes.
PICKUP_TS = "tpep_pickup_datetime"
PICKUP_LOCATION = "PULocationID"
DROPOFF_LOCATION = "DOLocationID"
ROUTE_PREFIX = "route_"
PICKUP_PREFIX = "pickup_"


def _usable(raw: DataFrame, name: str) -> Column:
    """Row test on the stored column, so that the Parquet reader can skip row groups."""
    column = F.col(name)
    if isinstance(raw.schema[name].dataType, T.NumericType):
        return column.isNotNull() & (column >= 1)
    return column.isNotNull()


def _with_position(raw: DataFrame) -> DataFrame:
    """Add where each row is stored; rows that do not come from files are stored first."""
    try:
        return raw.selectExpr("*", *FILE_POSITION)
    except AnalysisException:
        stored = store_table(raw, scratch_path(raw.sparkSession, "trips"))
        return stored.selectExpr("*", *FILE_POSITION)


def trips(
    raw: DataFrame,
    pickup_ts: str = PICKUP_TS,
    pickup_location: str = PICKUP_LOCATION,
    dropoff_location: str = DROPOFF_LOCATION,
    max_rows: int = 0,
) -> DataFrame:
    """Clean trip records: both places present and positive, time present.

    Places are whole numbers of up to 64 bits. ``max_rows`` > 0 keeps that many of the clean rows;
    which ones is not defined.
    """
    position = []
    if max_rows > 0:
        raw = _with_position(raw.select(pickup_ts, pickup_location, dropoff_location))
        position = [FILE, ROW]
    places = (
        raw.where(
            F.col(pickup_ts).isNotNull()
            & _usable(raw, pickup_location)
            & _usable(raw, dropoff_location)
        )
        .select(
            F.col(pickup_ts).try_cast("date").alias("pickup_date"),
            F.col(pickup_location).try_cast("bigint").alias("pickup"),
            F.col(dropoff_location).try_cast("bigint").alias("dropoff"),
            *position,
        )
        .where(F.col("pickup_date").isNotNull() & (F.col("pickup") > 0) & (F.col("dropoff") > 0))
    )
    if max_rows > 0:
        places = cap_rows(places, max_rows)
    return places.select(
        F.concat(
            F.lit(ROUTE_PREFIX),
            F.col("pickup").cast("string"),
            F.lit("_"),
            F.col("dropoff").cast("string"),
        ).alias("distinct_key"),
        F.concat(F.lit(PICKUP_PREFIX), F.col("pickup").cast("string")).alias("group_id"),
        F.col("pickup_date").alias("date_bucket"),
    )


def load_trips(spark: SparkSession, path: str, max_rows: int = 0) -> DataFrame:
    """Scan a Parquet trip table and clean it."""
    if not path:
        raise ValueError("An input path is required for the taxi dataset")
    return trips(spark.read.parquet(path), max_rows=max_rows)
