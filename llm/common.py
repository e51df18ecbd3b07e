"""Scratch tables in the shared folder, and small helpers that the operators share."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A word: a maximal run of characters outside space and U+0009 to U+000D.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Whether a query's shuffle files are deleted when it ends. Else they stay until the driver happens to
#: collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; where unset, one in the warehouse.

    A warehouse on the local disk will do on one machine only; elsewhere it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        is_local = spark.conf.get("spark.master", "local").startswith("local")
        if shared.startswith("file:") and not is_local:
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it.

    This cuts the lineage: what was stored survives the loss of any executor. The table stays until
    ``drop_scratch`` or ``drop_table``, since frames that read it may be evaluated later.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_and_free(df: DataFrame, label: str) -> DataFrame:
    """``store``, and delete the shuffle files that this took as soon as the table is written.

    The setting belongs to the session and is put back; a query of another thread that ends meanwhile
    loses its shuffle files too, which Spark makes anew where they are read again.
    """
    spark = df.sparkSession
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        return store(df, label)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def drop_table(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        _delete(spark, file.rsplit("/", 1)[0])


def drop_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application."""
    _delete(spark, scratch_root(spark))


def _delete(spark: SparkSession, path: str) -> None:
    root = scratch_root(spark).split(":", 1)[-1]
    if root not in path:
        raise ValueError(f"{path} is not a scratch table")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def fresh_name(df: DataFrame, base: str) -> str:
    """``base``, or with underscores after it until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
