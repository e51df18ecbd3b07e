"""The canonical input table that every distinct-count query reads."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from uniqtally.sources.storage import store_table
from uniqtally.sources.workloads import synthetic
from uniqtally.sources.trip_records import load_trips

# Column and view names of the canonical input.
DISTINCT_KEY = "distinct_key"
GROUP_ID = "group_id"
DATE_BUCKET = "date_bucket"
INPUT_VIEW = "benchmark_input"


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def canonicalize(
    df: DataFrame,
    key: Column | str,
    group: Column | str,
    ts: Column | str,
    empty_as_value: bool = False,
) -> DataFrame:
    """Project any table onto ``distinct_key``, ``group_id`` and ``date_bucket``.

    Sketches skip empty text. With ``empty_as_value`` every key that is not null gets a sign before
    it, so that all methods count empty text as one key more.
    """
    text = _column(key).cast("string")
    return df.select(
        (F.concat(F.lit("="), text) if empty_as_value else text).alias(DISTINCT_KEY),
        _column(group).cast("string").alias(GROUP_ID),
        F.to_date(_column(ts)).alias(DATE_BUCKET),
    )


def canonical_source(
    spark: SparkSession, dataset: str, input_path: str = "", max_rows: int = 0, **workload
) -> DataFrame:
    """Canonical rows by dataset name: ``synthetic`` or ``taxi``."""
    name = dataset.lower()
    if name == "synthetic":
        return synthetic(spark, **workload)
    if name == "taxi":
        return load_trips(spark, input_path, max_rows=max_rows)
    raise ValueError(f"Unsupported dataset: {dataset}")


def normalize_layout(df: DataFrame, path: str) -> DataFrame:
    """Store the input once, so that all methods scan the same files."""
    return store_table(df, path)


def normalize_and_count(df: DataFrame, path: str) -> tuple[DataFrame, int]:
    """Store the input and count its rows on the way, without a scan for the count.

    The tasks that write also count. What a repeated task counted replaces its first count.
    """
    written = Observation("normalized input")
    table = store_table(df.observe(written, F.count(F.lit(1)).alias("rows")), path)
    return table, written.get["rows"]


def bucketed_layout(df: DataFrame, path: str, buckets: int) -> DataFrame:
    """Store the different canonical rows of ``df`` in buckets by key, and return the table.

    Exact distinct counts of the key then need no shuffle of rows, by whatever columns they are
    grouped: equal keys lie in the same bucket, so each task counts its own. Only counts are sent on.
    Repeated rows are dropped before the rows are dealt by key, so a hot key brings no more rows than
    there are pairs of group and day; row counts and sums need the plain layout. The table is known to the session's
    catalog by the last part of ``path``; its name is in ``table_name``.
    """
    name = table_name(path)
    # Spark drops repeated rows by all columns, within each map task first; a hot key is spread there.
    rows = df.select(DISTINCT_KEY, GROUP_ID, DATE_BUCKET).distinct().repartition(buckets, DISTINCT_KEY)
    write = rows.write.mode("overwrite").bucketBy(buckets, DISTINCT_KEY).sortBy(DISTINCT_KEY)
    write.option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def table_name(path: str) -> str:
    """A name in the catalog for the table stored in ``path``."""
    return "bucketed_" + re.sub(r"\W", "_", path.rstrip("/").rsplit("/", 1)[-1])


def register_input(
    df: DataFrame, cache: bool = False, view: str = INPUT_VIEW, rows: int | None = None
) -> tuple[DataFrame, int]:
    """Name the input for SQL text and count its rows, unless ``rows`` says how many there are.

    ``cache`` suits repeated queries over an input that fits in executor memory; a larger one
    spills to local disks, so the default scans the stored files again.
    """
    table = df.cache() if cache else df
    rows = table.count() if rows is None else rows
    table.createOrReplaceTempView(view)
    return table, rows
