from pathlib import Path

import pytest
from catalogue import queries
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from plan_text import plan_of
from pyspark.sql import functions as F

from uniqtally.functions import (
    HLL,
    SKETCH_KINDS,
    THETA,
    empty_sketch,
    hll_distinct,
    sketch_kind,
    theta_distinct,
)
from uniqtally.operators import (
    ALL_QUERIES,
    DistinctQuery,
    approx,
    build_sketch_table,
    direct_sketch,
    distinct_estimate,
    estimates,
    exact,
    hash_groups_within,
    highest,
    lowest,
    many_groups,
    mean,
    measures_by,
    merge_by,
    merge_slots,
    read_sketch_table,
    rebuild_partitions,
    rollup,
    row_count,
    sketch,
    sketch_sizes,
    store_sketch_table,
    total,
    value_count,
)
from uniqtally.operators.merging import FALLBACK_THRESHOLD
from uniqtally.sources import scratch_path, store_table, synthetic
from uniqtally.sources.storage import is_any_of

GLOBAL, BY_GROUP, BY_DAY, BY_BOTH = ALL_QUERIES
KEYS = "distinct_key string, group_id string"


def all_methods(df, query):
    return {
        "exact": exact(df, query),
        "hllpp": approx(df, query),
        "theta": sketch(df, query, "theta"),
        "hll": sketch(df, query, "hll"),
        "theta_direct": direct_sketch(df, query, "theta"),
        "hll_direct": direct_sketch(df, query, "hll"),
        "theta_two_level": sketch(df, query, "theta", slots=4),
        "hll_two_level": sketch(df, query, "hll", slots=4),
    }


def answers(df):
    return {tuple(row)[:-1]: row["distinct_count"] for row in df.collect()}


def test_catalogue_of_queries():
    assert [(query.name, query.group_cols) for query in ALL_QUERIES] == [
        ("global_distinct", ()),
        ("grouped_distinct", ("group_id",)),
        ("time_window_distinct", ("date_bucket",)),
        ("multi_group_distinct", ("date_bucket", "group_id")),
    ]


def test_null_and_empty_keys(spark):
    rows = [(key, "g") for key in ("a", "b", "", None, "a")]
    counts = {
        name: df.first()["distinct_count"]
        for name, df in all_methods(spark.createDataFrame(rows, KEYS), GLOBAL).items()
    }
    assert counts["exact"] == counts["hllpp"] == 3
    assert all(value == 2.0 for name, value in counts.items() if name not in ("exact", "hllpp"))


@pytest.mark.parametrize("query", ALL_QUERIES[:2])
def test_no_rows(spark, query):
    empty = spark.createDataFrame([], KEYS)
    for df in all_methods(empty, query).values():
        assert [row["distinct_count"] for row in df.collect()] == ([] if query.group_cols else [0])


def test_groups_of_nulls(spark):
    df = spark.createDataFrame([(None, "p"), ("a", "q"), ("b", None)], KEYS)
    for answer in all_methods(df, BY_GROUP).values():
        assert answers(answer) == {("p",): 0, ("q",): 1, (None,): 1}


def test_result_types(spark):
    df = synthetic(spark, rows=10)
    for name, answer in all_methods(df, BY_BOTH).items():
        fields = {field.name: field.dataType.simpleString() for field in answer.schema}
        count = "bigint" if name in ("exact", "hllpp") else "double"
        assert fields == {"date_bucket": "date", "group_id": "string", "distinct_count": count}


@pytest.mark.parametrize("key", ["int", "bigint", "double", "date", "boolean", "decimal(9,2)"])
def test_keys_enter_sketches_by_their_text(spark, key):
    df = spark.range(300).select(
        (F.col("id") % 2 if key == "boolean" else F.col("id") % 40).alias("n")
    )
    value = F.date_add(F.lit("2024-01-01"), F.col("n").cast("int")) if key == "date" else (
        F.col("n").cast(key)
    )
    row = df.select(value.alias("k")).agg(theta_distinct("k"), hll_distinct("k")).first()
    expected = 2 if key == "boolean" else 40
    assert tuple(row) == (expected, expected)


@pytest.mark.parametrize("query", ALL_QUERIES)
def test_sql_text_answers_like_the_dataframe(spark, query):
    df = synthetic(spark, rows=5000, distinct=300, groups=4, days=3)
    df.createOrReplaceTempView("sql_input")
    assert answers(spark.sql(query.exact_sql("sql_input"))) == answers(exact(df, query))
    assert answers(spark.sql(query.approx_sql("sql_input", 0.01))) == answers(
        approx(df, query, 0.01)
    )
    for kind in SKETCH_KINDS:
        assert answers(spark.sql(query.sketch_sql("sql_input", kind, 14))) == answers(
            direct_sketch(df, query, kind, 14)
        )


def test_sql_text_quotes_names(spark):
    spark.createDataFrame([("a", 1), ("b", 1)], ["my key", "the`group"]).createOrReplaceTempView("q")
    query = DistinctQuery("odd", ("the`group",), "my key")
    assert answers(spark.sql(query.exact_sql("q"))) == {(1,): 2}


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(
            st.one_of(st.none(), st.text(alphabet="abc", min_size=1, max_size=3)),
            st.one_of(st.none(), st.sampled_from("xyz")),
        ),
        max_size=60,
    ),
    st.sampled_from([1, 3]),
)
def test_theta_counts_small_groups_exactly(spark, rows, slots):
    expected: dict = {}
    for key, group in rows:
        expected.setdefault((group,), set()).update(() if key is None else (key,))
    df = spark.createDataFrame(rows, KEYS).repartition(4)
    counts = {group: float(len(keys)) for group, keys in expected.items()}
    assert answers(sketch(df, BY_GROUP, THETA, slots=slots)) == counts
    assert answers(exact(df, BY_GROUP)) == counts


def test_hot_group(spark):
    """One group holds most rows and keys; both merge plans find the same sketches."""
    df = spark.range(0, 200_000, 1, 32).select(
        F.col("id").cast("string").alias("distinct_key"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias(
            "group_id"
        ),
    )
    truth = answers(exact(df, BY_GROUP))
    for kind in SKETCH_KINDS:
        flat, tree = (answers(sketch(df, BY_GROUP, kind, slots=slots)) for slots in (1, 8))
        for group, count in truth.items():
            assert flat[group] == pytest.approx(count, rel=0.065)
            assert tree[group] == pytest.approx(count, rel=0.065)
    assert answers(sketch(df, BY_GROUP, THETA, 18, slots=8)) == truth


def test_slots_do_not_depend_on_the_input(spark):
    assert merge_slots(spark) == 8
    small, large = (spark.range(0, n, 1, 10).selectExpr("id AS k") for n in (10, 1 << 40))
    count = DistinctQuery("all", (), "k")
    for build in (sketch, direct_sketch):
        shapes = [
            [line.strip(" +-()*") for line in plan_of(build(df, count, THETA)).split("\n\n")[0].split("\n")]
            for df in (small, large)
        ]
        assert shapes[0] == shapes[1]
        assert sum("Exchange" in line for line in shapes[0]) == 2


def test_sql_text_merges_in_two_levels(spark):
    synthetic(spark, rows=1000).createOrReplaceTempView("two_levels")
    plan = plan_of(spark.sql(BY_GROUP.sketch_sql("two_levels", HLL))).split("\n\n")[0]
    assert plan.count("Exchange") == 2


def test_partial_sketches_before_the_shuffle(spark):
    plan = plan_of(sketch(synthetic(spark, rows=10), BY_GROUP, THETA, slots=1))
    tree = plan.split("\n\n")[0]
    assert tree.count("Exchange") == 1 and tree.count("ObjectHashAggregate") == 2
    assert "partial_theta_sketch_agg" in plan
    assert "Python" not in plan and "ExistingRDD" not in plan


def test_two_level_plan(spark):
    plan = plan_of(sketch(synthetic(spark, rows=10), GLOBAL, HLL, slots=8))
    assert "partial_hll_sketch_agg" in plan and "partial_hll_union_agg" in plan
    assert "SPARK_PARTITION_ID" in plan


def test_exact_plan_spreads_hot_groups_by_key(spark):
    plan = plan_of(exact(synthetic(spark, rows=10), BY_GROUP))
    exchanges = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert any("group_id" in line and "distinct_key" in line for line in exchanges)


@pytest.mark.parametrize("kind", SKETCH_KINDS)
@pytest.mark.parametrize("query", ALL_QUERIES)
@pytest.mark.parametrize("slots", [1, 5])
def test_rollup_equals_direct_answer(spark, kind, query, slots):
    df = synthetic(spark, rows=20_000, distinct=500, groups=5, days=4, partitions=6)
    stored = build_sketch_table(df, kind=kind, lgk=14, slots=slots)
    rolled = answers(rollup(stored, query.group_cols, kind, 14, slots))
    truth = answers(exact(df, query))
    if kind is THETA:
        assert rolled == truth
    else:
        assert rolled.keys() == truth.keys()
        assert all(rolled[g] == pytest.approx(n, rel=0.03) for g, n in truth.items())


def test_sketch_table_shape(spark):
    df = synthetic(spark, rows=1000, groups=3, days=2)
    table = build_sketch_table(df)
    assert table.columns == ["date_bucket", "group_id", "sketch_bytes"]
    assert not table.schema["sketch_bytes"].nullable
    assert table.count() == 6
    with pytest.raises(ValueError, match="at least one group column"):
        build_sketch_table(df, [])
    sizes = sketch_sizes(table).first()
    assert sizes.num_sketch_rows == 6 and sizes.average_sketch_size_bytes > 0
    assert sketch_sizes(table.limit(0)).first().average_sketch_size_bytes == 0.0


@pytest.mark.parametrize("kind", SKETCH_KINDS)
def test_empty_sketch_is_neutral(spark, kind):
    table = build_sketch_table(synthetic(spark, rows=3000), ["group_id"], kind=kind)
    both = table.withColumn("merged", kind.merge_pair("sketch_bytes", empty_sketch(kind)))
    same = both.select(
        (kind.estimate("merged") == kind.estimate("sketch_bytes")).alias("same")
    ).distinct()
    assert [row.same for row in same.collect()] == [True]


def test_merge_at_a_lower_lgk(spark):
    df = synthetic(spark, rows=50_000, distinct=20_000, groups=2, days=2)
    truth = answers(exact(df, BY_GROUP))
    for kind in SKETCH_KINDS:
        stored = build_sketch_table(df, kind=kind, lgk=14)
        lower = answers(rollup(stored, ["group_id"], kind, 8))
        full = answers(rollup(stored, ["group_id"], kind, 14))
        assert lower != full
        assert all(lower[g] == pytest.approx(n, rel=0.3) for g, n in truth.items())
        assert all(full[g] == pytest.approx(n, rel=0.04) for g, n in truth.items())


@pytest.mark.parametrize("kind,bad", [(THETA, 3), (THETA, 27), (HLL, 3), (HLL, 22)])
def test_sketch_size_limits(kind, bad):
    with pytest.raises(ValueError, match="lgk"):
        kind.check_lgk(bad)


@pytest.mark.parametrize("slots", [1, 4])
@pytest.mark.parametrize("lgk", [8, 10, 12])
def test_hll_sizes_may_be_mixed(spark, lgk, slots):
    df = synthetic(spark, rows=30_000, distinct=20_000, groups=3)
    sizes = [build_sketch_table(df, kind="hll", lgk=k) for k in (9, 12)]
    truth = answers(exact(df, BY_GROUP))
    for mixed in (sizes[0].union(sizes[1]), sizes[1].union(sizes[0])):
        rolled = answers(rollup(mixed, ["group_id"], "hll", lgk, slots))
        assert all(rolled[g] == pytest.approx(n, rel=0.2) for g, n in truth.items())
        # No union is larger than the smallest of its parts, or than asked for.
        lengths = merge_by(mixed, ["group_id"], HLL, lgk, slots).agg(F.max(F.length("sketch_bytes")))
        assert lengths.first()[0] <= (1 << min(lgk, 9)) + 64
    same = rollup(sizes[1], ["group_id"], "hll", 12, slots)
    assert answers(same) == answers(rollup(sizes[1], ["group_id"], "hll", 14, slots))


def test_hll_rollup_takes_stored_rows_as_they_are(spark):
    table = build_sketch_table(synthetic(spark, rows=100), kind="hll")
    stored = store_table(table, scratch_path(spark, "test-hll"))
    plan = plan_of(rollup(stored, ["group_id"], HLL, 10, slots=4))
    tree = plan.split("\n\n")[0]
    assert "Subquery" not in plan and tree.count("Exchange") == 2
    # Nodes are described from the scan upwards: no scalar union comes before the first aggregate.
    details = plan.split("\n\n", 1)[1]
    assert "hll_union(" not in details[: details.index("partial_hll_union_agg")]
    assert details.count("hll_union(") == 1


# --- measures --------------------------------------------------------------------------------


def test_measures_by_hand(spark):
    rows = [("a", 1, 2.0), ("a", 1, None), ("a", None, 4.0), (None, 3, 1.0), ("b", None, None)]
    df = spark.createDataFrame(rows * 40, "g string, k int, x double").repartition(7)
    chosen = {
        "n": row_count(),
        "big": row_count(F.col("x") > 1.5),
        "known": value_count("x"),
        "k": distinct_estimate("k"),
        "k_hll": distinct_estimate("k", HLL),
        "sum": total("x"),
        "low": lowest("x"),
        "high": highest("x"),
        "mean": mean("x"),
    }
    expected = {
        "a": (120, 80, 80, 1.0, 1.0, 240.0, 2.0, 4.0, 3.0),
        None: (40, 0, 40, 1.0, 1.0, 40.0, 1.0, 1.0, 1.0),
        "b": (40, 0, 0, 0.0, 0.0, None, None, None, None),
    }
    for slots in (1, 3, None):
        got = measures_by(df, ["g"], chosen, slots).collect()
        assert {row[0]: tuple(row[1:]) for row in got} == expected
        whole = measures_by(df, [], chosen, slots).first()
        assert tuple(whole) == (200, 80, 120, 2.0, 2.0, 280.0, 1.0, 4.0, pytest.approx(280 / 120))
    nothing = df.where("g = 'c'")
    assert measures_by(nothing, ["g"], chosen).count() == 0
    assert tuple(measures_by(nothing, [], chosen).first()) == (0, 0, 0, 0.0, 0.0, *[None] * 4)
    with pytest.raises(ValueError, match="named like group columns"):
        measures_by(df, ["g"], {"G": row_count()})


def test_measures_spread_a_hot_group(spark):
    df = synthetic(spark, rows=1000)
    plan = plan_of(
        measures_by(df, ["group_id"], {"a": distinct_estimate("distinct_key"), "n": row_count()})
    )
    tree = plan.split("\n\n")[0]
    assert tree.count("Exchange") == 2
    keys = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "hashpartitioning" in line]
    # By group and slot first, then by group.
    assert sorted(key.count("#") for key in keys) == [1, 2] and "SPARK_PARTITION_ID" in plan
    for name in ("theta_customers_by_priority", "hll_ship_days_by_flag"):
        shown = plan_of(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "SPARK_PARTITION_ID" in shown


# --- partitioned sketch tables ---------------------------------------------------------------


def files_by_day(path):
    return {
        (file.parent.name, file.name): file.stat().st_mtime_ns
        for file in Path(path).rglob("*.parquet")
    }


def test_days_are_rebuilt_alone(spark, tmp_path):
    df = synthetic(spark, rows=4000, distinct=500, groups=4, days=5)
    days = [row[0] for row in df.select("date_bucket").distinct().orderBy("date_bucket").collect()]
    nulls = df.limit(50).withColumn("date_bucket", F.lit(None).cast("date"))
    df = df.union(nulls)
    path = str(tmp_path / "table")
    stored = store_sketch_table(df, path, kind="theta", partition_cols=["date_bucket"])
    truth = answers(exact(df, BY_BOTH))
    assert answers(estimates(stored, ["date_bucket", "group_id"], "theta")) == truth
    before = files_by_day(path)
    assert len({day for day, _ in before}) == 6
    less = df.where((F.col("date_bucket") != days[1]) | F.col("date_bucket").isNull())
    less = less.where("group_id <> 'group_0' OR date_bucket IS NULL")
    rebuilt = rebuild_partitions(less, path, [days[0], days[1], None])
    after = files_by_day(path)
    touched = {f"date_bucket={days[0]}", f"date_bucket={days[1]}", "date_bucket=__HIVE_DEFAULT_PARTITION__"}
    assert {k: v for k, v in before.items() if k[0] not in touched} == {
        k: v for k, v in after.items() if k[0] not in touched
    }
    # The second day has no rows any more, so no files; the first and the nulls have new ones.
    assert not before.keys() & {k for k in after if k[0] in touched}
    assert f"date_bucket={days[1]}" not in {day for day, _ in after}
    changed = answers(exact(less.where(is_any_of("date_bucket", [days[0], None])), BY_BOTH))
    kept = {k: v for k, v in truth.items() if k[0] in days[2:]}
    found = read_sketch_table(spark, path)
    for table in (rebuilt, found):
        assert answers(estimates(table, ["date_bucket", "group_id"], "theta")) == changed | kept
    plan = plan_of(rollup(found.where(F.col("date_bucket") >= days[3]), ["group_id"], "theta"))
    assert "PartitionFilters: [isnotnull(date_bucket" in plan


def test_sketch_kind_names():
    assert sketch_kind("Theta") is THETA and sketch_kind(HLL) is HLL
    with pytest.raises(ValueError, match="Unsupported sketch kind"):
        sketch_kind("kll")


def test_many_groups_keeps_the_answer_and_the_setting(spark):
    df = synthetic(spark, rows=20_000, distinct=100, groups=3000)
    query = DistinctQuery("groups", ("group_id",))
    before = spark.conf.get(FALLBACK_THRESHOLD)
    plain = answers(sketch(df, query, THETA))
    with many_groups(spark, THETA, 12, 1 << 30):
        assert spark.conf.get(FALLBACK_THRESHOLD) == "16384"
        assert answers(sketch(df, query, THETA)) == plain
    assert spark.conf.get(FALLBACK_THRESHOLD) == before


def test_groups_that_fit_a_memory_budget(spark):
    # Full-grown: 64 KB each.
    assert hash_groups_within(THETA, 12, 256 << 20) == 4096
    assert hash_groups_within(THETA, 26, 1) == 1
    assert hash_groups_within(HLL, 12, 1 << 30) > 200_000
    with many_groups(spark, HLL, 4, task_bytes=1 << 50):
        assert spark.conf.get(FALLBACK_THRESHOLD) == str(2**31 - 1)


def test_stored_sketch_estimates(spark):
    df = synthetic(spark, rows=2000, groups=3, days=2)
    stored = build_sketch_table(df)
    assert answers(estimates(stored, ["date_bucket", "group_id"], "theta")) == answers(
        exact(df, BY_BOTH)
    )
