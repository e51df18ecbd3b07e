"""One callable per query: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uniqtally.functions import (
    HLL,
    THETA,
    break_even_queries,
    size_ratio,
    hll_distinct,
    sketch_kind,
    theta_distinct,
    workload_exact_ms,
    workload_sketch_ms,
)
from uniqtally.operators import (
    DistinctQuery,
    approx,
    build_sketch_table,
    direct_sketch,
    distinct_estimate,
    error_rows,
    estimates,
    exact,
    highest,
    lowest,
    mean,
    measures_by,
    read_sketch_table,
    rebuild_partitions,
    rollup,
    row_count,
    runtime_stats,
    sketch,
    sketch_sizes,
    summarize_errors,
    summarize_exact,
    store_sketch_table,
    table_stats,
    total,
    value_count,
)
from uniqtally.plans import (
    MATRIX_SUMMARY_SCHEMA,
    METHOD_RESULT_SCHEMA,
    MATERIALIZATION_RESULT_SCHEMA,
    compare,
    compare_materialized,
    matrix_summary,
    read_report,
    report_text,
    with_costs,
    write_materialization_results,
    write_matrix_summary,
    write_method_results,
    write_report,
)
from uniqtally.plans import labels
from uniqtally.sources import (
    bucketed_layout,
    canonical_source,
    canonicalize,
    normalize_and_count,
    normalize_layout,
    register_input,
    scratch_path,
    store_table,
    stored_bytes,
    trips,
    workload_rows,
)

# Grain names of the registered queries and their group columns.
GRAINS: dict[str, tuple[str, ...]] = {
    "global": (),
    "by_group": ("group_id",),
    "by_day": ("date_bucket",),
    "by_day_group": ("date_bucket", "group_id"),
}
# Theta counts fewer than 2**16 different keys exactly at this size.
EXACT_LGK = 16
SKETCH_BOUND = 0.065
HLLPP_BOUND = 0.20
TRIP_CAP = 40_000

Query = Callable[[SparkSession, str], DataFrame]
_stored: dict[tuple, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonicalize(table(spark, sf_dir, "events"), "user_id", "event_type", "ts")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger key domain: orders by return flag and ship date."""
    lines = table(spark, sf_dir, "lineitem")
    return canonicalize(lines, "l_orderkey", "l_returnflag", "l_shipdate")


def line_trips(spark: SparkSession, sf_dir: str, max_rows: int = 0) -> DataFrame:
    """Order lines as trips from a supplier to a part."""
    lines = table(spark, sf_dir, "lineitem")
    return trips(lines, "l_shipdate", "l_suppkey", "l_partkey", max_rows)


def grain_query(grain: str) -> DistinctQuery:
    return DistinctQuery(grain, GRAINS[grain])


def bounded(truth: DataFrame, answer: DataFrame, group_cols, bound: float) -> DataFrame:
    """Group columns, the exact count, and whether the estimate is close enough to it."""
    return error_rows(truth, answer, group_cols).select(
        *group_cols, "exact_count", (F.col("relative_error") <= bound).alias("within_bound")
    )


def is_stored(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def stored_sketches(spark: SparkSession, sf_dir: str, kind: str, lgk: int) -> str:
    """Path of the sketch table of the events; built once per session and table folder."""
    key = (spark.sparkContext.applicationId, sf_dir, kind, lgk)
    if key not in _stored or not is_stored(spark, _stored[key]):
        path = scratch_path(spark, f"sketches-{kind}-{lgk}")
        store_sketch_table(events(spark, sf_dir), path, kind=kind, lgk=lgk)
        _stored[key] = path
    return _stored[key]


def sketch_lgk(kind: str) -> int:
    return EXACT_LGK if kind == "theta" else 12


def sketches(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return read_sketch_table(spark, stored_sketches(spark, sf_dir, kind, sketch_lgk(kind)))


# --- sources ---------------------------------------------------------------------------------


def trip_clean_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_trips(spark, sf_dir, TRIP_CAP).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(
            F.col("distinct_key").isNull()
            | F.col("group_id").isNull()
            | F.col("date_bucket").isNull()
        ).alias("n_incomplete"),
    )


def trip_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trip table with the raw column names, stored and then loaded by the name of its dataset."""
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("tpep_pickup_datetime"),
        F.col("l_suppkey").alias("PULocationID"),
        F.col("l_partkey").cast("double").alias("DOLocationID"),
    )
    path = scratch_path(spark, "raw-trips")
    store_table(raw, path)
    return canonical_source(spark, "taxi", path)


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_layout(events(spark, sf_dir), scratch_path(spark, "events"))


def named_input_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = register_input(events(spark, sf_dir), view="named_events")
    counted = spark.sql("SELECT group_id, COUNT(*) AS n_rows FROM named_events GROUP BY group_id")
    return counted.select("*", F.lit(rows).cast("long").alias("input_rows"))


def counted_while_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stored and counted in one job, then counted by group from the stored files."""
    stored, rows = normalize_and_count(events(spark, sf_dir), scratch_path(spark, "counted-events"))
    counted = stored.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.select("*", F.lit(rows).cast("long").alias("input_rows"))


def exact_bucketed(grain: str) -> Query:
    """Exact counts of orders from a layout in buckets by key."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch_path(spark, f"bucketed-orders-{grain}")
        return exact(bucketed_layout(order_lines(spark, sf_dir), path, 8), grain_query(grain))

    return run


def synthetic_rows(workload: str, distinct: int, groups: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
        return workload_rows(ids, workload, distinct, groups, days=30)

    return run


# --- distinct counts -------------------------------------------------------------------------


def exact_grain(grain: str) -> Query:
    return lambda spark, sf_dir: exact(events(spark, sf_dir), grain_query(grain))


def hllpp_grain(grain: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, query = events(spark, sf_dir), grain_query(grain)
        return bounded(exact(df, query), approx(df, query), query.group_cols, HLLPP_BOUND)

    return run


def theta_grain(grain: str, slots: int | None = None) -> Query:
    return lambda spark, sf_dir: sketch(
        events(spark, sf_dir), grain_query(grain), THETA, EXACT_LGK, slots
    )


def hll_grain(grain: str, slots: int | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, query = events(spark, sf_dir), grain_query(grain)
        answer = sketch(df, query, HLL, slots=slots)
        return bounded(exact(df, query), answer, query.group_cols, SKETCH_BOUND)

    return run


def sketch_by_flag(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, query = order_lines(spark, sf_dir), grain_query("by_group")
        answer = sketch(df, query, kind, 12)
        return bounded(exact(df, query), answer, query.group_cols, SKETCH_BOUND)

    return run


def orders_by(grain: str, method: str) -> Query:
    """Estimates of orders, globally and by flag too many to be counted exactly, against the exact count."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, query = order_lines(spark, sf_dir), grain_query(grain)
        answer = approx(df, query) if method == "hllpp" else sketch(df, query, method, 12)
        bound = HLLPP_BOUND if method == "hllpp" else SKETCH_BOUND
        return bounded(exact(df, query), answer, query.group_cols, bound)

    return run


def orders_rollup(grain: str, kind: str, lgk: int = 12) -> Query:
    """The same from sketches by day and flag."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, query = order_lines(spark, sf_dir), grain_query(grain)
        stored = store_sketch_table(df, scratch_path(spark, f"order-sketches-{kind}"), kind=kind)
        answer = rollup(stored, query.group_cols, kind, lgk)
        bound = HLLPP_BOUND if lgk < 12 else SKETCH_BOUND
        return bounded(exact(df, query), answer, query.group_cols, bound)

    return run


def union_of_flags(kind: str) -> Query:
    """Orders with a return flag or the one after it, by merging the sketches of both."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, flags = order_lines(spark, sf_dir), GRAINS["by_group"]
        built = build_sketch_table(df, flags, kind=kind)
        before = F.translate("group_id", "ANR", "RAN").alias("group_id")
        following = built.select(before, F.col("sketch_bytes").alias("next_bytes"))
        both = sketch_kind(kind).merge_pair("sketch_bytes", "next_bytes", 12)
        pairs = built.join(following, "group_id").select("group_id", both.alias("sketch_bytes"))
        own_and_before = F.explode(F.array("group_id", before)).alias("group_id")
        truth = exact(df.select("distinct_key", own_and_before), grain_query("by_group"))
        return bounded(truth, estimates(pairs, flags, kind), flags, SKETCH_BOUND)

    return run


def exact_routes_by_pickup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact(line_trips(spark, sf_dir), grain_query("by_group"))


def exact_sql_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    events(spark, sf_dir).createOrReplaceTempView("day_events")
    return spark.sql(grain_query("by_day").exact_sql("day_events"))


def hllpp_sql_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, query = events(spark, sf_dir), grain_query("by_group")
    df.createOrReplaceTempView("hllpp_group_events")
    answer = spark.sql(query.approx_sql("hllpp_group_events"))
    return bounded(exact(df, query), answer, query.group_cols, HLLPP_BOUND)


def theta_sql_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    events(spark, sf_dir).createOrReplaceTempView("theta_group_events")
    return spark.sql(grain_query("by_group").sketch_sql("theta_group_events", THETA, EXACT_LGK))


def hll_sql_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, query = events(spark, sf_dir), grain_query("by_group")
    df.createOrReplaceTempView("hll_group_events")
    answer = spark.sql(query.sketch_sql("hll_group_events", HLL))
    return bounded(exact(df, query), answer, query.group_cols, SKETCH_BOUND)


def theta_direct_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return direct_sketch(events(spark, sf_dir), grain_query("by_day"), THETA, EXACT_LGK)


def hll_direct_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, query = events(spark, sf_dir), grain_query("by_day")
    return bounded(exact(df, query), direct_sketch(df, query, HLL), query.group_cols, SKETCH_BOUND)


def theta_customers_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = distinct_estimate("o_custkey", "theta", EXACT_LGK)
    orders = table(spark, sf_dir, "orders")
    return measures_by(orders, ["o_orderpriority"], {"customers": customers})


def line_measures(group_cols: tuple[str, ...]) -> Query:
    """Distinct estimates next to plain measures, all in one plan of two levels."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = table(spark, sf_dir, "lineitem")
        found = measures_by(
            lines,
            group_cols,
            {
                "parts": distinct_estimate("l_partkey", "theta", EXACT_LGK),
                "suppliers": distinct_estimate("l_suppkey", "theta", EXACT_LGK),
                "supplier_estimate": distinct_estimate("l_suppkey", "hll"),
                "n_lines": row_count(),
                "n_discounted": row_count(F.col("l_discount") > 0),
                "n_flags": value_count(F.nullif("l_returnflag", F.lit("N"))),
                "pieces": total(F.col("l_quantity").cast("long")),
                "first_day": lowest(F.to_date("l_shipdate")),
                "last_day": highest(F.to_date("l_shipdate")),
                "mean_line": mean(F.col("l_linenumber").cast("long")),
            },
        )
        close = F.abs(F.col("supplier_estimate") / F.col("suppliers") - 1) <= SKETCH_BOUND
        return found.withColumn("supplier_estimate", close).withColumn(
            "mean_line", F.round("mean_line", 8)
        )

    return run


def hll_ship_days_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates enter a sketch by their text."""
    lines = table(spark, sf_dir, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    truth = exact(lines, DistinctQuery("days_by_flag", ("l_returnflag",), "day"))
    days = {"distinct_count": distinct_estimate("day", "hll")}
    answer = measures_by(lines, ["l_returnflag"], days)
    return bounded(truth, answer, ("l_returnflag",), SKETCH_BOUND)


def hll_column_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bare column helpers, as one aggregate expression each."""
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(
        theta_distinct("l_suppkey", EXACT_LGK).alias("suppliers"),
        (
            F.abs(hll_distinct("l_suppkey") / theta_distinct("l_suppkey", EXACT_LGK) - 1)
            <= SKETCH_BOUND
        ).alias("within_bound"),
    )


def theta_suppliers_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Very many small groups: no order is spread over many splits, so one merge level will do."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "group_id")
    return sketch(lines, DistinctQuery("by_order", ("group_id",), "l_suppkey"), THETA, slots=1)


def null_and_empty_keys(
    spark: SparkSession, sf_dir: str, empty_as_value: bool = False
) -> DataFrame:
    """Nulls are counted by no method; empty text by the exact one only, unless it is a value."""
    key = (
        F.when(F.col("event_type") == "view", F.lit(None))
        .when(F.col("event_type") == "click", F.lit(""))
        .otherwise(F.col("user_id").cast("string"))
    )
    # Views form a group in which every key is null.
    group = F.when(F.col("event_type") == "view", F.lit("view"))
    df = canonicalize(table(spark, sf_dir, "events"), key, group, "ts", empty_as_value)
    query = grain_query("by_group")
    answer = sketch(df, query, THETA, EXACT_LGK)
    return error_rows(exact(df, query), answer, query.group_cols, null_safe=True).select(
        "group_id", "exact_count", F.col("approx_count").alias("theta_count")
    )


# --- sketch tables ---------------------------------------------------------------------------


def sketch_table_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimates(sketches(spark, sf_dir, "theta"), GRAINS["by_day_group"], THETA)


def sketch_table_hll(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = grain_query("by_day_group")
    answer = estimates(sketches(spark, sf_dir, "hll"), query.group_cols, HLL)
    truth = exact(events(spark, sf_dir), query)
    return bounded(truth, answer, query.group_cols, SKETCH_BOUND)


def rollup_theta(grain: str, slots: int | None = None) -> Query:
    return lambda spark, sf_dir: rollup(
        sketches(spark, sf_dir, "theta"), GRAINS[grain], THETA, EXACT_LGK, slots
    )


def rollup_hll(grain: str, lgk: int = 12, slots: int | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        query = grain_query(grain)
        answer = rollup(
            sketches(spark, sf_dir, "hll"), query.group_cols, HLL, lgk, slots
        )
        truth = exact(events(spark, sf_dir), query)
        return bounded(truth, answer, query.group_cols, HLLPP_BOUND if lgk < 12 else SKETCH_BOUND)

    return run


def _consecutive_days(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Each day's sketch merged with the next day's, per group."""
    days = sketches(spark, sf_dir, kind)
    following = days.select(
        "group_id",
        F.date_sub("date_bucket", 1).alias("date_bucket"),
        F.col("sketch_bytes").alias("next_bytes"),
    )
    both = sketch_kind(kind).merge_pair("sketch_bytes", "next_bytes", sketch_lgk(kind))
    pairs = days.join(following, ["date_bucket", "group_id"]).select(
        "date_bucket", "group_id", both.alias("sketch_bytes")
    )
    return estimates(pairs, GRAINS["by_day_group"], kind)


def union_pairs_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consecutive_days(spark, sf_dir, "theta")


def union_pairs_hll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The HLL estimate against the Theta one, which is exact for these groups."""
    truth = _consecutive_days(spark, sf_dir, "theta")
    return bounded(
        truth, _consecutive_days(spark, sf_dir, "hll"), GRAINS["by_day_group"], SKETCH_BOUND
    )


def days_of_events(spark: SparkSession, sf_dir: str) -> list:
    """The first day of the events and the two weeks after it."""
    first = events(spark, sf_dir).agg(F.min("date_bucket")).first()[0]
    return [first + timedelta(days=n) for n in range(14)]


def rollup_theta_day_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By group, over one week: only the folders of its days are read."""
    path = scratch_path(spark, "sketches-by-day")
    by_day = {"partition_cols": ["date_bucket"], "kind": "theta", "lgk": EXACT_LGK}
    stored = store_sketch_table(events(spark, sf_dir), path, **by_day)
    days = days_of_events(spark, sf_dir)
    week = stored.where(F.col("date_bucket").between(days[1], days[7]))
    return rollup(week, ["group_id"], THETA, EXACT_LGK)


def sketch_table_rebuilt_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that lacks half the users of two days, and all of a third, with these days rebuilt."""
    path = scratch_path(spark, "sketches-rebuilt")
    df, days = events(spark, sf_dir), days_of_events(spark, sf_dir)
    damaged = F.col("date_bucket").isin(days[2:4]) & (F.col("distinct_key").cast("int") % 2 == 0)
    incomplete = df.where(~damaged & (F.col("date_bucket") != days[5]))
    store_sketch_table(incomplete, path, lgk=EXACT_LGK, partition_cols=["date_bucket"])
    rebuilt = rebuild_partitions(df, path, [*days[2:4], days[5]], lgk=EXACT_LGK)
    return rollup(rebuilt, ["date_bucket"], THETA, EXACT_LGK)


def rollup_hll_mixed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of three sizes, by day, rolled up together by group at a size between them."""
    df, query = events(spark, sf_dir), grain_query("by_group")
    place = F.pmod(F.dayofmonth("date_bucket"), F.lit(3))
    parts = [
        build_sketch_table(df.where(place == n), kind=HLL, lgk=lgk)
        for n, lgk in enumerate((10, 12, 14))
    ]
    answer = rollup(parts[0].union(parts[1]).union(parts[2]), query.group_cols, HLL, 13)
    return bounded(exact(df, query), answer, query.group_cols, HLLPP_BOUND)


def sketch_sizes_small_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean length of the sketches of the orders of each part, which follows from their numbers."""
    lines = table(spark, sf_dir, "lineitem")
    built = build_sketch_table(lines, ["l_partkey"], "l_orderkey", HLL, slots=1)
    return sketch_sizes(built).select(
        "num_sketch_rows", F.round("average_sketch_size_bytes", 6).alias("average_size")
    )


def stored_text_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of a table written as lines of text, which is known to the byte."""
    path = scratch_path(spark, "order-lines")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string"))
    orders.write.text(path)
    return stored_bytes(spark, path)


def sketch_table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stored_sketches(spark, sf_dir, "theta", EXACT_LGK)
    raw = f"{sf_dir}/events.parquet"
    stats = table_stats(spark, read_sketch_table(spark, path), path, raw)
    return stats.select(
        "num_sketch_rows",
        # A sketch holds at least its preamble and at most eight bytes per nominal entry.
        F.col("average_sketch_size_bytes")
        .between(8, 24 + (8 << EXACT_LGK))
        .alias("average_size_in_range"),
        (F.col("sketch_table_size_bytes") > 0).alias("has_sketch_bytes"),
        (F.col("raw_input_size_bytes") > 0).alias("has_raw_bytes"),
    )


# --- accuracy --------------------------------------------------------------------------------


def _orders_and_parts(spark: SparkSession, sf_dir: str, grain: str, null_flag: bool = False):
    """Two deterministic counts to compare: orders as the exact side, parts as the other."""
    lines = table(spark, sf_dir, "lineitem")
    group = F.col("l_suppkey")
    if null_flag:
        group = F.nullif(F.col("l_returnflag"), F.lit("A"))
    query = grain_query(grain)
    return (
        exact(canonicalize(lines, "l_orderkey", group, "l_shipdate"), query),
        exact(canonicalize(lines, "l_partkey", group, "l_shipdate"), query),
        query.group_cols,
    )


def _rounded_errors(rows: DataFrame, group_cols) -> DataFrame:
    return rows.select(
        *group_cols,
        "exact_count",
        "approx_count",
        F.round("relative_error", 8).alias("relative_error"),
    )


def _rounded_summary(summary: DataFrame) -> DataFrame:
    return summary.select(
        "num_groups",
        "exact_cardinality",
        "approximate_cardinality",
        *[
            F.round(f"relative_error_{name}", 8).alias(f"relative_error_{name}")
            for name in ("mean", "median", "p95", "max")
        ],
    )


def error_rows_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, answer, cols = _orders_and_parts(spark, sf_dir, "by_group")
    return _rounded_errors(error_rows(truth, answer, cols), cols)


def error_rows_null_groups(null_safe: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        truth, answer, cols = _orders_and_parts(spark, sf_dir, "by_group", null_flag=True)
        return _rounded_errors(error_rows(truth, answer, cols, null_safe), cols)

    return run


def error_summary(grain: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        truth, answer, cols = _orders_and_parts(spark, sf_dir, grain)
        return _rounded_summary(summarize_errors(error_rows(truth, answer, cols)))

    return run


def exact_summary(grain: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        truth, _, _ = _orders_and_parts(spark, sf_dir, grain, null_flag=True)
        return _rounded_summary(summarize_exact(truth))

    return run


# --- runtimes and costs ----------------------------------------------------------------------


def runtime_stats_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values stand in for milliseconds."""
    samples = table(spark, sf_dir, "events").select(
        "event_type", F.floor("value").cast("long").alias("elapsed_ms")
    )
    return runtime_stats(samples, ["event_type"]).select(
        "event_type",
        "runtime_ms",
        F.round("runtime_mean_ms", 6).alias("runtime_mean_ms"),
        "runtime_min_ms",
        "runtime_max_ms",
        F.round("runtime_stddev_ms", 6).alias("runtime_stddev_ms"),
        "runtime_trials",
    )


def cost_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order counts stand in for milliseconds; some customers never pay a build back."""
    times = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            (F.count(F.lit(1)) * 100).alias("build_ms"),
            F.count_if(F.col("o_totalprice") >= 100000).alias("exact_ms"),
            F.count_if(F.col("o_totalprice") < 100000).alias("sketch_ms"),
        )
    )
    build, exact_ms, sketch_ms = F.col("build_ms"), F.col("exact_ms"), F.col("sketch_ms")
    return times.select(
        "o_custkey",
        workload_exact_ms(5, exact_ms).alias("workload_5_exact_ms"),
        workload_sketch_ms(5, build, sketch_ms).alias("workload_5_sketch_ms"),
        workload_exact_ms(10, exact_ms).alias("workload_10_exact_ms"),
        workload_sketch_ms(10, build, sketch_ms).alias("workload_10_sketch_ms"),
        break_even_queries(build, exact_ms, sketch_ms).alias("break_even_queries"),
    )


def cost_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost columns of the materialization table, from the same stand-ins."""
    times = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            (F.count(F.lit(1)) * 100).alias("build_time_ms"),
            F.count_if(F.col("o_totalprice") >= 100000).alias("exact_query_time_ms"),
            F.count_if(F.col("o_totalprice") < 100000).alias("sketch_query_time_ms"),
        )
    )
    return with_costs(times).drop("build_time_ms", "exact_query_time_ms", "sketch_query_time_ms")


def size_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as raw bytes, those of low price as sketch bytes; some have none."""
    sizes = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            F.count(F.lit(1)).alias("raw"),
            F.count_if(F.col("o_totalprice") < 100000).alias("sketch"),
        )
    )
    ratio = size_ratio(F.col("raw"), F.col("sketch"))
    return sizes.select("o_custkey", F.round(ratio, 8).alias("ratio"))


# --- comparisons and reports -----------------------------------------------------------------


def _compare_events(spark: SparkSession, df: DataFrame, include_direct: bool = True):
    return compare(
        df,
        "events",
        theta_lgk=EXACT_LGK,
        warmups=1,
        trials=1,
        include_direct=include_direct,
        view="compared_events" if include_direct else "compared_without_direct",
    )


def _checked(results: DataFrame, prefix: str) -> list:
    """Exact columns as they are; estimates and times by whether they are plausible."""
    low, high = F.col(f"{prefix}_min_ms"), F.col(f"{prefix}_max_ms")
    return [
        "exact_cardinality",
        (F.col("relative_error_max") <= HLLPP_BOUND).alias("within_bound"),
        (
            F.abs(F.col("approximate_cardinality") - F.col("exact_cardinality"))
            <= HLLPP_BOUND * F.col("exact_cardinality")
        ).alias("sum_within_bound"),
        (
            (low >= 0)
            & (low <= F.col(f"{prefix}_mean_ms"))
            & (F.col(f"{prefix}_mean_ms") <= high)
            & (F.col(f"{prefix}_stddev_ms") >= 0)
        ).alias("times_ordered"),
        "runtime_trials",
    ]


def method_results(include_direct: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        results = _compare_events(spark, events(spark, sf_dir), include_direct).results
        return results.select(
            "dataset",
            "query_name",
            "method",
            "input_rows",
            "num_groups",
            *_checked(results, "runtime"),
            "relative_sd",
            "notes",
        )

    return run


def materialization_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir)
    results = compare_materialized(
        df,
        _compare_events(spark, df),
        "events",
        f"{sf_dir}/events.parquet",
        theta_lgk=EXACT_LGK,
        trials=1,
    )
    return results.select(
        "dataset",
        "sketch_type",
        "materialization_group",
        "query_name",
        "input_rows",
        "num_sketch_rows",
        *_checked(results, "sketch_query"),
        (F.col("sketch_table_size_bytes") > 0).alias("has_sketch_bytes"),
        "notes",
    )


def csv_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "value", "props")
    missing = F.when(F.col("value") < 10, F.col("value")).alias("relative_sd")
    return report_text(rows.select("event_id", "value", missing, "props"))


def _daily_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.to_date("ts").alias("day"), "event_type")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_distinct("user_id").alias("users"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.min("props").alias("notes"),
        )
        .withColumn("day", F.col("day").cast("string"))
    )


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily results written as a report and read back; notes hold quotes and commas."""
    results = _daily_results(spark, sf_dir).withColumn(
        "notes", F.concat(F.lit("a,b "), F.col("notes"))
    )
    results = results.withColumn("low", F.when(F.col("users") > 50, F.col("low")))
    path = write_report(results, scratch_path(spark, "report"))
    return read_report(spark, path, results.schema)


def result_file(schema, write) -> Query:
    """A result table of figures made from the daily results, written as CSV and read back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        daily = _daily_results(spark, sf_dir)
        made = {
            "string": lambda i: F.concat_ws(", ", F.lit(f'"{i}"'), "event_type", "day"),
            "bigint": lambda i: F.col("n_rows") + i,
            "int": lambda i: (F.col("users") + i).cast("int"),
            "double": lambda i: F.col("n_rows") / 4 + i,
        }
        columns = [
            made[f.dataType.simpleString()](i).alias(f.name) for i, f in enumerate(schema)
        ]
        path = write(daily.select(*columns), scratch_path(spark, "results"))
        return read_report(spark, path, schema)

    return run


def matrix_summary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_matrix_summary(matrix_summary_by_day(spark, sf_dir), scratch_path(spark, "matrix"))
    return read_report(spark, path, MATRIX_SUMMARY_SCHEMA)


def matrix_summary_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day stands in for a run and each event type for a query; some figures are missing.

    The daily results, one row per day and type, are stored and read for all three tables.
    """
    daily = store_table(_daily_results(spark, sf_dir), scratch_path(spark, "daily"))
    runs = daily.groupBy(F.col("day").alias("run_dir")).agg(
        F.lit("events").alias("dataset"),
        F.lit("uniform").alias("workload"),
        F.sum("n_rows").alias("rows"),
        F.lit("cold").alias("regime"),
    )
    names = [labels.EXACT, labels.APPROX, labels.THETA_PARTITIONED, labels.HLL_PARTITIONED]
    methods = daily.select(
        F.col("day").alias("run_dir"),
        F.col("event_type").alias("query_name"),
        F.posexplode(F.array(*[F.lit(name) for name in names])).alias("place", "method"),
        F.col("users").alias("num_groups"),
        F.col("n_rows").alias("n_rows"),
    ).select(
        "run_dir",
        "query_name",
        "method",
        "num_groups",
        (F.col("n_rows") + F.col("place")).alias("runtime_ms"),
    )
    methods = methods.where(~((F.col("query_name") == "view") & (F.col("method") == labels.EXACT)))
    materialized = daily.select(
        F.col("day").alias("run_dir"),
        F.col("event_type").alias("query_name"),
        F.posexplode(F.array(F.lit("theta"), F.lit("hll"))).alias("place", "sketch_type"),
        "n_rows",
        "users",
        "low",
        "high",
    ).select(
        "run_dir",
        "query_name",
        "sketch_type",
        (F.col("users") * 2).alias("num_sketch_rows"),
        (F.col("n_rows") * 3 + F.col("place")).alias("exact_query_time_ms"),
        (F.col("n_rows") * 5 + F.col("place")).alias("sketch_query_time_ms"),
        (F.col("n_rows") * 7 + F.col("place")).alias("build_time_ms"),
        F.col("high").alias("raw_to_sketch_size_ratio"),
        F.col("low").alias("relative_error_median"),
        (F.col("low") + F.col("place")).alias("relative_error_p95"),
        F.col("n_rows").cast("string").alias("break_even_queries"),
    )
    materialized = materialized.where(
        ~((F.col("query_name") == "error") & (F.col("sketch_type") == "hll"))
    )
    return matrix_summary(runs, methods, materialized)


QUERIES: dict[str, Query] = {
    "canonical_events": events,
    "trip_clean": line_trips,
    "trip_clean_capped": trip_clean_capped,
    "trip_dataset": trip_dataset,
    "stored_events": stored_events,
    "named_input_rows": named_input_rows,
    "counted_while_stored": counted_while_stored,
    "synth_uniform": synthetic_rows("uniform", 10_000, 100),
    "synth_high_cardinality": synthetic_rows("high_cardinality", 1_000_000, 100),
    "synth_many_groups": synthetic_rows("many-groups", 10_000, 1000),
    "synth_skewed": synthetic_rows("skewed", 10_000, 100),
    **{f"exact_{grain}": exact_grain(grain) for grain in GRAINS},
    "exact_routes_by_pickup": exact_routes_by_pickup,
    **{f"exact_bucketed_{grain}": exact_bucketed(grain) for grain in ("global", "by_group")},
    "exact_sql_by_day": exact_sql_by_day,
    **{f"hllpp_{grain}": hllpp_grain(grain) for grain in GRAINS},
    "hllpp_sql_by_group": hllpp_sql_by_group,
    **{f"theta_{grain}": theta_grain(grain) for grain in GRAINS},
    **{f"theta_two_level_{grain}": theta_grain(grain, slots=16) for grain in GRAINS},
    "theta12_by_flag": sketch_by_flag("theta"),
    "theta_sql_by_group": theta_sql_by_group,
    "theta_direct_by_day": theta_direct_by_day,
    "theta_customers_by_priority": theta_customers_by_priority,
    "theta_suppliers_by_order": theta_suppliers_by_order,
    "line_measures_by_flag": line_measures(("l_returnflag", "l_linestatus")),
    "line_measures": line_measures(()),
    "columns_by_status": hll_column_by_status,
    **{f"hll_{grain}": hll_grain(grain) for grain in GRAINS},
    "hll_two_level_by_group": hll_grain("by_group", slots=16),
    "hll12_by_flag": sketch_by_flag("hll"),
    "hll_sql_by_group": hll_sql_by_group,
    "hll_direct_by_day": hll_direct_by_day,
    "hll_ship_days_by_flag": hll_ship_days_by_flag,
    **{
        f"{method}12_orders_{grain}": orders_by(grain, method)
        for method in ("theta", "hll")
        for grain in ("global", "by_day_group")
    },
    "hllpp_orders_global": orders_by("global", "hllpp"),
    "hllpp_orders_by_flag": orders_by("by_group", "hllpp"),
    **{
        f"rollup_{kind}12_orders_{grain}": orders_rollup(grain, kind)
        for kind in ("theta", "hll")
        for grain in ("global", "by_group")
    },
    "rollup_hll_lower_lgk_orders": orders_rollup("by_group", "hll", lgk=10),
    "union_flags_theta": union_of_flags("theta"),
    "union_flags_hll": union_of_flags("hll"),
    "null_and_empty_keys": null_and_empty_keys,
    "empty_keys_as_values": partial(null_and_empty_keys, empty_as_value=True),
    "sketch_table_theta": sketch_table_theta,
    "sketch_table_hll": sketch_table_hll,
    "sketch_table_stats": sketch_table_stats,
    **{f"rollup_theta_{grain}": rollup_theta(grain) for grain in GRAINS},
    **{f"rollup_hll_{grain}": rollup_hll(grain) for grain in GRAINS},
    "rollup_theta_two_level_by_day": rollup_theta("by_day", slots=16),
    "rollup_hll_lower_lgk_by_day": rollup_hll("by_day", lgk=10),
    "rollup_hll_mixed_sizes": rollup_hll_mixed_sizes,
    "rollup_theta_day_range": rollup_theta_day_range,
    "sketch_table_rebuilt_days": sketch_table_rebuilt_days,
    "sketch_sizes_small_groups": sketch_sizes_small_groups,
    "stored_text_bytes": stored_text_bytes,
    "union_pairs_theta": union_pairs_theta,
    "union_pairs_hll": union_pairs_hll,
    "error_rows": error_rows_by_group,
    "error_rows_null_groups": error_rows_null_groups(null_safe=False),
    "error_rows_null_safe": error_rows_null_groups(null_safe=True),
    "error_summary": error_summary("by_group"),
    "error_summary_by_day_group": error_summary("by_day_group"),
    "error_summary_global": error_summary("global"),
    "exact_summary": exact_summary("by_group"),
    "runtime_stats": runtime_stats_by_type,
    "cost_model": cost_model,
    "cost_columns": cost_columns,
    "size_ratios": size_ratios,
    "method_results": method_results(include_direct=True),
    "method_results_without_direct": method_results(include_direct=False),
    "materialization_results": materialization_results,
    "csv_format": csv_format,
    "csv_roundtrip": csv_roundtrip,
    "method_result_file": result_file(METHOD_RESULT_SCHEMA, write_method_results),
    "materialization_result_file": result_file(
        MATERIALIZATION_RESULT_SCHEMA, write_materialization_results
    ),
    "matrix_summary": matrix_summary_by_day,
    "matrix_summary_file": matrix_summary_file,
}
