"""Time every method on every query and set its answers against the exact ones."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import AbstractContextManager, nullcontext
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from uniqtally.functions.metrics import (
    break_even_queries,
    workload_exact_ms,
    workload_sketch_ms,
)
from uniqtally.functions.sketches import DEFAULT_LGK, HLL, THETA, SketchKind
from uniqtally.operators.accuracy import (
    SUMMARY_COLUMNS,
    error_rows,
    summarize_errors,
    summarize_exact,
)
from uniqtally.operators.distinct import (
    ALL_QUERIES,
    DEFAULT_RELATIVE_SD,
    DistinctQuery,
    sketch,
)
from uniqtally.operators.merging import many_groups
from uniqtally.operators.runtime import runtime_stats, time_trials, trial_rows, trials_frame
from uniqtally.operators.sketch_table import (
    MATERIALIZED_GRAIN,
    build_sketch_table,
    read_sketch_table,
    rollup,
    table_stats,
)
from uniqtally.plans import labels
from uniqtally.plans.report import (
    MATERIALIZATION_RESULT_SCHEMA,
    METHOD_RESULT_SCHEMA,
    conform,
)
from uniqtally.sources.canonical import INPUT_VIEW
from uniqtally.sources.storage import scratch_path, store_table

BUILD = "build"
METHOD_ROWS = (
    "position int, query_name string, method string, relative_sd double, notes string"
)
STORED_ROWS = "position int, query_name string, sketch_type string"


@dataclass(frozen=True)
class Method:
    """One way to answer a distinct query over the named input."""

    name: str
    run: Callable[[DataFrame, DistinctQuery], DataFrame]
    notes: str
    relative_sd: float | None = None
    global_notes: str | None = None
    sketch: tuple[SketchKind, int] | None = None


@dataclass(frozen=True)
class Comparison:
    """Results of ``compare``: the result table, all trials, and each method's stored counts."""

    results: DataFrame
    input_rows: int
    trials: list[tuple] = field(repr=False)
    counts: dict[tuple[str, str], DataFrame] = field(repr=False)

    def exact_counts(self, query: DistinctQuery) -> DataFrame:
        return self.counts[query.name, labels.EXACT]

    def exact_trials(self) -> list[tuple]:
        return [row for row in self.trials if row[1] == labels.EXACT]


def comparison_methods(
    spark: SparkSession,
    view: str = INPUT_VIEW,
    relative_sd: float = DEFAULT_RELATIVE_SD,
    theta_lgk: int = DEFAULT_LGK,
    hll_lgk: int = DEFAULT_LGK,
    include_direct: bool = True,
    slots: int | None = None,
) -> list[Method]:
    """The exact method first, then the approximate ones; direct aggregates can be left out."""
    sql_slots = {} if slots is None else {"slots": slots}
    methods = [
        Method(
            labels.EXACT,
            lambda df, query: spark.sql(query.exact_sql(view)),
            labels.EXACT_GROUPED_NOTE,
            global_notes=labels.EXACT_NOTE,
        ),
        Method(
            labels.APPROX,
            lambda df, query: spark.sql(query.approx_sql(view, relative_sd)),
            labels.APPROX_NOTE,
            relative_sd,
        ),
        Method(
            labels.THETA_PARTITIONED,
            lambda df, query: sketch(df, query, THETA, theta_lgk, slots),
            labels.THETA_PARTITIONED_NOTE.format(lgk=theta_lgk),
            sketch=(THETA, theta_lgk),
        ),
        Method(
            labels.HLL_PARTITIONED,
            lambda df, query: sketch(df, query, HLL, hll_lgk, slots),
            labels.HLL_PARTITIONED_NOTE.format(lgk=hll_lgk),
            sketch=(HLL, hll_lgk),
        ),
    ]
    if include_direct:
        methods += [
            Method(
                labels.THETA_DIRECT,
                lambda df, query: spark.sql(
                    query.sketch_sql(view, THETA, theta_lgk, **sql_slots)
                ),
                labels.THETA_DIRECT_NOTE.format(lgk=theta_lgk),
                sketch=(THETA, theta_lgk),
            ),
            Method(
                labels.HLL_DIRECT,
                lambda df, query: spark.sql(
                    query.sketch_sql(view, HLL, hll_lgk, **sql_slots)
                ),
                labels.HLL_DIRECT_NOTE.format(lgk=hll_lgk),
                sketch=(HLL, hll_lgk),
            ),
        ]
    return methods


def _room_for(
    df: DataFrame, sketch: tuple[SketchKind, int] | None, task_bytes: int | None
) -> AbstractContextManager:
    """Room for the groups of a sketch method, if the caller gives any; other methods need none."""
    if sketch is None or task_bytes is None:
        return nullcontext()
    return many_groups(df.sparkSession, *sketch, task_bytes)


def _measure(
    build: Callable[[], DataFrame], path: str, warmups: int, trials: int
) -> tuple[DataFrame, list[int]]:
    """Timed runs, and the answer stored by one untimed run (the first warm-up, if there is one).

    A stored answer outlives lost executors, and no later trial can read it in place of the work
    that is to be timed, as it could read a cached plan.
    """
    if warmups > 0:
        stored = store_table(build(), path)
        return stored, time_trials(build, warmups - 1, trials)
    samples = time_trials(build, 0, trials)
    return store_table(build(), path), samples


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _error_summaries(
    query: DistinctQuery, truth: DataFrame, answers: dict[str, DataFrame], kind: str
) -> DataFrame:
    """One row per answer to a query, named in the column ``kind``; the exact one is read once."""
    every = _union([answer.withColumn(kind, F.lit(name)) for name, answer in answers.items()])
    rows = error_rows(truth, every, query.group_cols, keep=[kind])
    return summarize_errors(rows, by=[kind]).withColumn("query_name", F.lit(query.name))


def _with_summaries(rows: DataFrame, summaries: Sequence[DataFrame], kind: str) -> DataFrame:
    """Add the summaries; an answer without any common group has zeros."""
    joined = rows.join(_union(summaries), ["query_name", kind], "left")
    return joined.fillna(0, list(SUMMARY_COLUMNS))


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("position")


def compare(
    df: DataFrame,
    dataset: str,
    queries: Sequence[DistinctQuery] = ALL_QUERIES,
    relative_sd: float = DEFAULT_RELATIVE_SD,
    theta_lgk: int = DEFAULT_LGK,
    hll_lgk: int = DEFAULT_LGK,
    warmups: int = 1,
    trials: int = 3,
    include_direct: bool = True,
    view: str = INPUT_VIEW,
    store: str | None = None,
    task_bytes: int | None = None,
    input_rows: int | None = None,
    slots: int | None = None,
) -> Comparison:
    """Run all methods on all queries over a canonical table.

    ``input_rows`` saves counting them again.
    ``task_bytes`` is what one task may spend on sketches under construction, ``slots`` the number of
    slices in which sketches are merged first.
    """
    spark = df.sparkSession
    store = store or scratch_path(spark, "counts")
    df.createOrReplaceTempView(view)
    input_rows = df.count() if input_rows is None else input_rows

    methods = comparison_methods(
        spark, view, relative_sd, theta_lgk, hll_lgk, include_direct, slots
    )
    counts: dict[tuple[str, str], DataFrame] = {}
    timed: list[tuple] = []
    rows: list[tuple] = []
    summaries: list[DataFrame] = []
    for query in queries:
        for method in methods:
            with _room_for(df, method.sketch, task_bytes):
                counts[query.name, method.name], samples = _measure(
                    lambda: method.run(df, query),
                    f"{store}/{query.name}/{method.name}",
                    warmups,
                    trials,
                )
            timed += trial_rows(query.name, method.name, samples)
            notes = method.notes if query.group_cols else method.global_notes or method.notes
            rows.append((len(rows), query.name, method.name, method.relative_sd, notes))
        truth = counts[query.name, labels.EXACT]
        answers = {
            method.name: counts[query.name, method.name]
            for method in methods
            if method.name != labels.EXACT
        }
        summaries += [
            summarize_exact(truth).select(
                "*", F.lit(labels.EXACT).alias("method"), F.lit(query.name).alias("query_name")
            ),
            _error_summaries(query, truth, answers, "method"),
        ]

    stats = runtime_stats(trials_frame(spark, timed))
    named = spark.createDataFrame(rows, METHOD_ROWS).join(stats, ["query_name", "method"])
    joined = _with_summaries(named, summaries, "method").select(
        "*", F.lit(dataset).alias("dataset"), F.lit(input_rows).alias("input_rows")
    )
    results = conform(_in_order(joined), METHOD_RESULT_SCHEMA)
    return Comparison(results, input_rows, timed, counts)


def _stats_of(
    stats: DataFrame, methods: list[str], key: str, prefix: str, median: str, *more: Column | str
) -> DataFrame:
    """Runtime figures of some methods, under the names of the materialization table."""
    return stats.where(F.col("method").isin(methods)).select(
        F.col("query_name").alias(key),
        F.col("runtime_ms").alias(median),
        *[
            F.col(f"runtime_{figure}_ms").alias(f"{prefix}_{figure}_ms")
            for figure in ("mean", "min", "max", "stddev")
        ],
        *more,
    )


def with_costs(rows: DataFrame) -> DataFrame:
    """Add what 5 and 10 repeated queries cost either way, and the break-even point."""
    build, exact_ms, sketch_ms = (
        F.col("build_time_ms"),
        F.col("exact_query_time_ms"),
        F.col("sketch_query_time_ms"),
    )
    return rows.select(
        "*",
        workload_exact_ms(5, exact_ms).alias("workload_5_exact_ms"),
        workload_sketch_ms(5, build, sketch_ms).alias("workload_5_sketch_ms"),
        workload_exact_ms(10, exact_ms).alias("workload_10_exact_ms"),
        workload_sketch_ms(10, build, sketch_ms).alias("workload_10_sketch_ms"),
        break_even_queries(build, exact_ms, sketch_ms).alias("break_even_queries"),
    )


def compare_materialized(
    df: DataFrame,
    comparison: Comparison,
    dataset: str,
    raw_path: str,
    queries: Sequence[DistinctQuery] = ALL_QUERIES,
    grain: Sequence[str] = MATERIALIZED_GRAIN,
    theta_lgk: int = DEFAULT_LGK,
    hll_lgk: int = DEFAULT_LGK,
    warmups: int = 1,
    trials: int = 3,
    cache_sketch_table: bool = False,
    store: str | None = None,
    task_bytes: int | None = None,
    slots: int | None = None,
) -> DataFrame:
    """Build a sketch table of each kind and answer all queries from it.

    ``slots=1`` builds and merges in one level, for a grain none of whose groups is found in many
    splits. The exact times are those that ``compare`` measured; they are not taken again. ``raw_path`` is
    where ``df`` is stored, for its size.
    """
    spark = df.sparkSession
    store = store or scratch_path(spark, "materialized_sketches")
    timed = comparison.exact_trials()
    tables: list[DataFrame] = []
    rows: list[tuple] = []
    answers: dict[str, dict[str, DataFrame]] = {query.name: {} for query in queries}
    for kind, lgk in ((THETA, theta_lgk), (HLL, hll_lgk)):
        path = f"{store}/{kind.name}"

        def build() -> DataFrame:
            return build_sketch_table(df, grain, kind=kind, lgk=lgk, slots=slots)

        with _room_for(df, (kind, lgk), task_bytes):
            stored, samples = _measure(build, path, warmups, trials)
        timed += trial_rows(kind.name, BUILD, samples)
        tables.append(
            table_stats(spark, stored, path, raw_path).withColumn("sketch_type", F.lit(kind.name))
        )
        table = read_sketch_table(spark, path, cache_sketch_table)
        for query in queries:
            with _room_for(table, (kind, lgk), task_bytes):
                answers[query.name][kind.name], samples = _measure(
                    lambda: rollup(table, query.group_cols, kind, lgk, slots),
                    f"{store}_counts/{kind.name}/{query.name}",
                    warmups,
                    trials,
                )
            timed += trial_rows(query.name, kind.name, samples)
            rows.append((len(rows), query.name, kind.name))
        if cache_sketch_table:
            table.unpersist()

    stats = runtime_stats(trials_frame(spark, timed))
    build_stats = _stats_of(stats, [BUILD], "sketch_type", "build", "build_time_ms")
    exact_stats = _stats_of(
        stats, [labels.EXACT], "query_name", "exact_query", "exact_query_time_ms"
    )
    sketch_stats = _stats_of(
        stats,
        [THETA.name, HLL.name],
        "query_name",
        "sketch_query",
        "sketch_query_time_ms",
        F.col("method").alias("sketch_type"),
        "runtime_trials",
    )
    grain_name = "+".join(grain)
    summaries = [
        _error_summaries(query, comparison.exact_counts(query), answers[query.name], "sketch_type")
        for query in queries
    ]
    named = spark.createDataFrame(rows, STORED_ROWS)
    joined = (
        _with_summaries(named, summaries, "sketch_type")
        .join(_union(tables), "sketch_type")
        .join(build_stats, "sketch_type")
        .join(exact_stats, "query_name")
        .join(sketch_stats, ["query_name", "sketch_type"])
        .withColumn("dataset", F.lit(dataset))
        .withColumn("input_rows", F.lit(comparison.input_rows))
        .withColumn("materialization_group", F.lit(grain_name))
        .withColumn("notes", F.lit(labels.MATERIALIZED_NOTE.format(grain=grain_name)))
    )
    return conform(_in_order(with_costs(joined)), MATERIALIZATION_RESULT_SCHEMA)
