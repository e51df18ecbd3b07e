"""Where tables are stored, and how large they are."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_DIR = "spark.checkpoint.dir"
SIZE_TASKS = 256


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; where none is named, one in the warehouse.

    A warehouse on the local disk will do on one machine only; elsewhere it is an error.
    """
    if shared := spark.conf.get(CHECKPOINT_DIR, None):
        return shared.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    is_local = spark.conf.get("spark.master", "local").startswith("local")
    if warehouse.startswith("file:") and not is_local:
        raise ValueError(f"Set {CHECKPOINT_DIR} to a folder that all executors share")
    return f"{warehouse}/_scratch".rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder."""
    return f"{scratch_root(spark)}/uniqtally/{label}-{uuid.uuid4().hex}"


def store_table(df: DataFrame, path: str, partition_cols: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet, replacing what is there, and return a scan of the stored files.

    With ``partition_cols`` there is a folder per value. The rows are brought together by them first,
    so that a value has few files; one with many rows is still written by several tasks.
    """
    rows = df.hint("rebalance", *partition_cols) if partition_cols else df
    rows.write.mode("overwrite").partitionBy(*partition_cols).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_any_of(name: str, values: Sequence) -> Column:
    """Whether a column has one of ``values``, among which may be None."""
    column, known = F.col(name), [value for value in values if value is not None]
    found = column.isin(known) if known else F.lit(False)
    return found | column.isNull() if len(known) < len(values) else found


def replace_partitions(df: DataFrame, path: str, partition_col: str, values: Sequence) -> None:
    """Replace the partitions ``values`` of a stored table by the rows of ``df``.

    All rows must belong to these partitions. Files of others are not touched. Only the names of the
    files in the chosen partitions come to the driver.
    """
    spark = df.sparkSession

    def files() -> set[str]:
        chosen = spark.read.schema(df.schema).parquet(path).where(is_any_of(partition_col, values))
        return {row[0] for row in chosen.select("_metadata.file_path").distinct().collect()}

    before = files()
    rows = df.hint("rebalance", partition_col).write.mode("overwrite").partitionBy(partition_col)
    rows.option("partitionOverwriteMode", "dynamic").parquet(path)
    # The write leaves a partition alone for which it had no row; then its old files are still there.
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    for name in before & files():
        place = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        place.getFileSystem(configuration).delete(place, False)


def stored_bytes(spark: SparkSession, path: str) -> DataFrame:
    """One row: bytes of all data files below ``path``, 0 if it is absent.

    Only file lengths are read, never contents. The listing is folded into a fixed number of tasks,
    because Spark would otherwise plan one task per file-split worth of bytes that nobody reads.
    """
    try:
        files = (
            spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        ).select("length")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], T.StructType([T.StructField("length", T.LongType())]))
    return files.coalesce(SIZE_TASKS).agg(
        F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("stored_bytes")
    )
