"""Timed evaluation of queries and statistics over the trials."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIAL_SCHEMA = T.StructType(
    [
        T.StructField("query_name", T.StringType(), False),
        T.StructField("method", T.StringType(), False),
        T.StructField("trial", T.IntegerType(), False),
        T.StructField("elapsed_ms", T.LongType(), False),
    ]
)
TRIAL_KEYS = ("query_name", "method")


def evaluate(df: DataFrame) -> None:
    """Compute every row and column of ``df`` and drop them.

    Counting the rows instead would let the optimizer remove the aggregate that is to be timed.
    """
    df.write.format("noop").mode("overwrite").save()


def time_trials(
    build: Callable[[], DataFrame],
    warmups: int = 1,
    trials: int = 3,
    warm_up: Callable[[DataFrame], None] = evaluate,
) -> list[int]:
    """Milliseconds of each timed run; the frame is built anew for every run."""
    for _ in range(max(warmups, 0)):
        warm_up(build())
    samples = []
    for _ in range(max(trials, 1)):
        start = time.perf_counter_ns()
        evaluate(build())
        samples.append((time.perf_counter_ns() - start) // 1_000_000)
    return samples


def trial_rows(query_name: str, method: str, samples: Iterable[int]) -> list[tuple]:
    rows = [(query_name, method, trial, ms) for trial, ms in enumerate(samples)]
    if not rows:
        raise ValueError("Runtime statistics need at least one sample")
    return rows


def trials_frame(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    if not rows:
        raise ValueError("Runtime statistics need at least one sample")
    return spark.createDataFrame(list(rows), TRIAL_SCHEMA)


def runtime_stats(
    trials: DataFrame, keys: Sequence[str] = TRIAL_KEYS, elapsed: str = "elapsed_ms"
) -> DataFrame:
    """Per key: median (half up to a whole number), mean, extremes, population deviation, count.

    Equal samples are counted before the shuffle; what one task keeps per key is bounded by the
    number of different millisecond values.
    """
    median = F.percentile(F.col(elapsed), 0.5)
    return trials.groupBy(*keys).agg(
        F.floor(median + 0.5).cast("long").alias("runtime_ms"),
        F.avg(elapsed).alias("runtime_mean_ms"),
        F.min(elapsed).alias("runtime_min_ms"),
        F.max(elapsed).alias("runtime_max_ms"),
        F.stddev_pop(elapsed).alias("runtime_stddev_ms"),
        F.count(F.lit(1)).cast("int").alias("runtime_trials"),
    )
