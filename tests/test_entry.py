import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from catalogue import queries
from catalogue.oracles import ORACLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{file}'")
    yield connection
    connection.close()


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((value is None, str(value)) for value in row))


def test_every_query_has_a_counterpart():
    assert queries.QUERIES.keys() == ORACLES.keys()
    assert queries.QUERIES.items() <= entry_module.queries().items()
    assert entry_module.oracle_sql().keys() <= entry_module.queries().keys()


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["group_id", "distinct_count"]
    assert df.count() == 5


def test_lost_sketch_tables_are_built_again(spark, monkeypatch):
    key = (spark.sparkContext.applicationId, SF_DIR, "hll", 12)
    monkeypatch.setitem(queries._stored, key, "/tmp/uniqtally-no-such-table")
    path = queries.stored_sketches(spark, SF_DIR, "hll", 12)
    assert path != "/tmp/uniqtally-no-such-table" and queries.is_stored(spark, path)
    assert queries.stored_sketches(spark, SF_DIR, "hll", 12) == path


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, sql, name):
    df = entry_module.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    cursor = sql.execute(entry_module.oracle_sql()[name])
    described = {column[0]: str(column[1]) for column in cursor.description}
    assert sorted(described) == columns
    assert [TYPES[df.schema[c].dataType.simpleString()] for c in columns] == [
        described[c] for c in columns
    ]
    position = [list(described).index(c) for c in columns]
    expected = [tuple(row[i] for i in position) for row in cursor.fetchall()]
    assert ordered(tuple(row) for row in df.select(*columns).collect()) == ordered(expected)
