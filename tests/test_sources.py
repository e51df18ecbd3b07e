import datetime as dt

import pytest
from plan_text import plan_of
from pyspark.sql import functions as F

from uniqtally.operators import ALL_QUERIES, exact
from uniqtally.sources import (
    bucketed_layout,
    canonical_source,
    canonicalize,
    cap_rows,
    load_trips,
    matrix_parameters,
    normalize_and_count,
    normalize_layout,
    register_input,
    scratch_root,
    stored_bytes,
    synthetic,
    table_name,
    trips,
)
from uniqtally.sources.row_cap import FILE, ROW

TRIP_SCHEMA = "tpep_pickup_datetime timestamp_ntz, PULocationID {0}, DOLocationID {0}"
NOON = dt.datetime(2024, 3, 1, 12)


def test_uniform_golden_rows(spark):
    rows = synthetic(spark, rows=3, distinct=100_000, groups=100, days=30).orderBy("id").collect()
    assert [tuple(row) for row in rows] == [
        (0, "key_6847", "group_50", dt.date(2024, 1, 8)),
        (1, "key_12199", "group_17", dt.date(2024, 1, 3)),
        (2, "key_85808", "group_21", dt.date(2024, 1, 28)),
    ]


def test_generator_does_not_depend_on_slicing(spark):
    one = synthetic(spark, rows=1000, partitions=1)
    many = synthetic(spark, rows=1000, partitions=7)
    assert many.rdd.getNumPartitions() == 7
    assert one.exceptAll(many).count() == 0


def test_parameters_are_clamped(spark):
    df = synthetic(spark, rows=50, distinct=0, groups=-1, days=0, partitions=0)
    assert [tuple(row) for row in df.drop("id").distinct().collect()] == [
        ("key_0", "group_0", dt.date(2024, 1, 1))
    ]


@pytest.mark.parametrize("name", ["high-cardinality", "HIGH_CARDINALITY"])
def test_workload_names(spark, name):
    plain = synthetic(spark, "high_cardinality", rows=100)
    assert synthetic(spark, name, rows=100).exceptAll(plain).count() == 0


def test_workloads_use_their_own_salts(spark):
    def column(name, workload):
        return [row[0] for row in synthetic(spark, workload, rows=200).select(name).collect()]

    assert column("distinct_key", "uniform") == column("distinct_key", "many_groups")
    assert column("distinct_key", "uniform") != column("distinct_key", "high_cardinality")
    assert column("group_id", "uniform") == column("group_id", "high_cardinality")
    assert column("group_id", "uniform") != column("group_id", "many_groups")
    assert column("date_bucket", "uniform") == column("date_bucket", "skewed")


def test_unknown_names_are_errors(spark):
    with pytest.raises(ValueError, match="Unsupported synthetic workload"):
        synthetic(spark, "zipf")
    with pytest.raises(ValueError, match="Unsupported dataset"):
        canonical_source(spark, "pages")
    with pytest.raises(ValueError, match="input path is required"):
        canonical_source(spark, "Taxi")


def test_skewed_shares(spark):
    df = synthetic(spark, "skewed", rows=100_000, distinct=10_000, groups=100)
    number = F.split("group_id", "_")[1].cast("int")
    key = F.split("distinct_key", "_")[1].cast("int")
    hot, warm, keys = df.agg(
        F.avg((number < 5).cast("double")),
        F.avg((number < 20).cast("double")),
        F.avg((key < 500).cast("double")),
    ).first()
    assert hot == pytest.approx(0.838, abs=0.002)
    assert warm == pytest.approx(0.959, abs=0.002)
    assert keys == pytest.approx(0.714, abs=0.002)


def test_matrix_parameters():
    assert matrix_parameters("uniform", 1_000_000) == (100_000, 100)
    assert matrix_parameters("high_cardinality", 1_000_000) == (1_000_000, 100)
    assert matrix_parameters("many_groups", 5) == (1, 1000)


@pytest.mark.parametrize("kind", ["bigint", "double", "string", "int"])
def test_trip_cleaning(spark, kind):
    cast = {"double": float, "string": str}.get(kind, int)
    places = [(1, 2), (None, 2), (1, None), (0, 2), (1, 0), (-3, 2), (7, 7)]
    rows = [
        (NOON, *(None if place is None else cast(place) for place in pair)) for pair in places
    ]
    rows.append((None, cast(1), cast(2)))
    df = trips(spark.createDataFrame(rows, TRIP_SCHEMA.format(kind)))
    assert sorted(tuple(row) for row in df.collect()) == [
        ("route_1_2", "pickup_1", NOON.date()),
        ("route_7_7", "pickup_7", NOON.date()),
    ]


def test_trip_values_that_are_no_places(spark):
    doubles = [(NOON, 0.5, 1.0), (NOON, 1.9, 2.0), (NOON, float("nan"), 2.0), (NOON, 1e12, 2.0)]
    df = trips(spark.createDataFrame(doubles, TRIP_SCHEMA.format("double")))
    assert [row.distinct_key for row in df.collect()] == ["route_1_2", "route_1000000000000_2"]
    texts = [("2024-03-01 10:00:00", "3", "4"), ("soon", "3", "4"), ("2024-03-01", "x", "4")]
    schema = "tpep_pickup_datetime string, PULocationID string, DOLocationID string"
    df = trips(spark.createDataFrame(texts, schema))
    assert [tuple(row) for row in df.collect()] == [("route_3_4", "pickup_3", NOON.date())]


def _trip_files(spark, path, rows=10_000, files=5):
    ids = spark.range(0, rows, 1, files)
    ids.select(
        F.lit(NOON).cast("timestamp_ntz").alias("tpep_pickup_datetime"),
        (F.col("id") % 50).alias("PULocationID"),
        F.col("id").alias("DOLocationID"),
    ).write.parquet(path)


@pytest.mark.parametrize("limit", [1, 1999, 2000, 4321, 9800, 9801])
def test_row_cap_is_exact(spark, tmp_path, limit):
    path = str(tmp_path / "trips")
    _trip_files(spark, path)
    every = load_trips(spark, path)
    assert every.count() == 9800
    capped = load_trips(spark, path, max_rows=limit)
    assert capped.count() == min(limit, 9800)
    assert capped.exceptAll(every).count() == 0


@pytest.mark.parametrize("widths", [(1,), (7, 1), (100, 10, 1), (5000, 50, 1)])
def test_row_cap_ranges(spark, tmp_path, monkeypatch, widths):
    monkeypatch.setattr("uniqtally.sources.row_cap.WIDTHS", widths)
    monkeypatch.setattr("uniqtally.sources.row_cap.FIRST_BATCH", 1)
    path = str(tmp_path / "trips")
    _trip_files(spark, path, rows=300, files=3)
    rows = spark.read.parquet(path).where("PULocationID > 10").select(
        "DOLocationID",
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.row_index").alias(ROW),
    )
    capped = cap_rows(rows, 123)
    assert capped.count() == 123
    assert capped.columns == ["DOLocationID"]
    first = [row[0] for row in rows.orderBy(FILE, ROW).limit(123).collect()]
    assert sorted(row[0] for row in capped.collect()) == sorted(first)


@pytest.mark.parametrize("limit", [32_768, 32_769, 70_001])
def test_row_cap_in_a_large_file(spark, tmp_path, limit):
    path = str(tmp_path / "trips")
    _trip_files(spark, path, rows=100_000, files=1)
    capped = load_trips(spark, path, max_rows=limit)
    assert capped.count() == limit
    last = capped.agg(F.max(F.split("distinct_key", "_")[2].cast("int"))).first()[0]
    # 49 of 50 rows are clean, in the order of their ids.
    assert last == (limit - 1) // 49 * 50 + (limit - 1) % 49 + 1


def test_row_cap_needs_no_single_task(spark, tmp_path):
    path = str(tmp_path / "trips")
    _trip_files(spark, path)
    plan = plan_of(load_trips(spark, path, max_rows=1500))
    assert "SinglePartition" not in plan and "Limit" not in plan
    # The cut lies in the first file, so the later files are not read at all.
    scanned = load_trips(spark, path, max_rows=1500).rdd.getNumPartitions()
    assert scanned == 1


def test_row_cap_counts_no_file_behind_the_cut(spark, tmp_path):
    path = str(tmp_path / "trips")
    _trip_files(spark, path, rows=400, files=8)
    (last,) = sorted(spark.read.parquet(path).inputFiles())[-1:]
    with open(last.removeprefix("file://").removeprefix("file:"), "wb") as file:
        file.write(b"no Parquet")
    schema = "tpep_pickup_datetime timestamp_ntz, PULocationID bigint, DOLocationID bigint"
    raw = spark.read.schema(schema).parquet(path)
    assert trips(raw, max_rows=60).count() == 60


def test_row_cap_above_an_int(spark, tmp_path):
    path = str(tmp_path / "trips")
    _trip_files(spark, path, rows=200)
    assert load_trips(spark, path, max_rows=5_000_000_000).count() == load_trips(spark, path).count()


def test_row_cap_without_files(spark):
    rows = [(NOON, 1, place) for place in range(1, 50)]
    raw = spark.createDataFrame(rows, TRIP_SCHEMA.format("int"))
    assert trips(raw, max_rows=20).count() == 20


def test_trip_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "trips")
    _trip_files(spark, path)
    plan = plan_of(load_trips(spark, path))
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "GreaterThanOrEqual(PULocationID,1)" in pushed
    assert "IsNotNull(tpep_pickup_datetime)" in pushed


def test_canonicalize_reads_only_its_columns(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df = canonicalize(events, "user_id", "event_type", "ts")
    assert [f.dataType.simpleString() for f in df.schema] == ["string", "string", "date"]
    assert "struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan_of(df)


def test_stored_and_named_input(spark, tmp_path):
    path = str(tmp_path / "input.parquet")
    df = synthetic(spark, rows=500)
    stored = normalize_layout(df, path)
    assert stored.exceptAll(df).count() == 0
    table, rows = register_input(stored, cache=True, view="input_test")
    try:
        assert rows == 500 and spark.table("input_test").count() == 500
        assert table.is_cached
    finally:
        table.unpersist()
    assert normalize_layout(df.limit(10), path).count() == 10


def test_rows_are_counted_while_stored(spark, tmp_path):
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "")
    table, rows = normalize_and_count(synthetic(spark, rows=5000), str(tmp_path / "input"))
    named, same = register_input(table, view="counted_input", rows=rows)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert (rows, same, named.count()) == (5000, 5000, 5000)
    assert len(jobs.getJobIdsForGroup("counted")) == 1
    empty = normalize_and_count(table.where("group_id = 'no'"), str(tmp_path / "nothing"))
    assert empty[1] == 0


def test_exact_counts_of_buckets_move_no_rows(spark, tmp_path):
    df = synthetic(spark, rows=20_000, distinct=3000, groups=7, days=3)
    hot = df.limit(5000).withColumn("distinct_key", F.lit("hot"))
    odd = df.limit(3).withColumn("distinct_key", F.lit(None).cast("string"))
    df = df.union(hot).union(odd)
    table = bucketed_layout(df, str(tmp_path / "in-buckets"), 5)
    for query in ALL_QUERIES:
        # Below the one exchange of counts each task has removed duplicates already.
        tree = plan_of(exact(table, query)).split("\n\n")[0]
        counted = exact(table, query).collect()
        assert sorted(map(str, counted)) == sorted(map(str, exact(df, query).collect()))
        assert tree.count("Exchange") == 1
        assert tree[tree.rindex("Exchange") :].count("HashAggregate") == 3
    assert table.where("distinct_key = 'hot'").count() <= 21
    spark.sql(f"DROP TABLE {table_name(str(tmp_path / 'in-buckets'))}")


def test_stored_bytes(spark, tmp_path):
    path = tmp_path / "deep"
    synthetic(spark, rows=500).withColumn("part", F.col("id") % 2).write.partitionBy("part").parquet(
        str(path)
    )
    expected = sum(file.stat().st_size for file in path.rglob("*.parquet"))
    assert expected > 0
    assert stored_bytes(spark, str(path)).first()[0] == expected
    assert stored_bytes(spark, str(tmp_path / "absent")).first()[0] == 0
    assert "ReadSchema: struct<length:bigint>" in plan_of(stored_bytes(spark, str(path)))


class Session:
    """Settings only."""

    def __init__(self, **settings):
        self.conf = {f"spark.{name.replace('_', '.')}": text for name, text in settings.items()}


def test_scratch_root_is_the_shared_folder(spark):
    assert scratch_root(Session(checkpoint_dir="s3://shared/folder/")) == "s3://shared/folder"
    unnamed = Session(sql_warehouse_dir="s3://warehouse")
    assert scratch_root(unnamed) == "s3://warehouse/_scratch"
    assert scratch_root(Session(sql_warehouse_dir="file:/a")) == "file:/a/_scratch"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(Session(sql_warehouse_dir="file:/a", master="yarn"))
    assert scratch_root(spark)


def test_empty_keys_as_values(spark):
    rows = [(key, "g", NOON) for key in ("a", "b", "", None, "a")]
    events = spark.createDataFrame(rows, "k string, g string, ts timestamp")
    for switch, keys in ((False, {"a", "b", "", None}), (True, {"=a", "=b", "=", None})):
        df = canonicalize(events, "k", "g", "ts", empty_as_value=switch)
        assert {row.distinct_key for row in df.collect()} == keys
