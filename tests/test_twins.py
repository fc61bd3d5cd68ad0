"""Every query against its SQL twin in DuckDB, on whole tables."""

import duckdb
import pytest

import __spark_entry__ as entry_point

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES = entry_point.queries()
TWINS = entry_point.oracle_sql()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "double": "DOUBLE",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    result = duck.execute(TWINS[name])
    columns = [column[0] for column in result.description]
    kinds = {column[0]: str(column[1]) for column in result.description}
    assert sorted(frame.columns) == sorted(columns)
    assert {f.name: TYPES[f.dataType.simpleString()] for f in frame.schema.fields} == kinds
    order = sorted(columns)
    place = {column: i for i, column in enumerate(columns)}
    expected = sorted((tuple(row[place[c]] for c in order) for row in result.fetchall()), key=repr)
    got = sorted((tuple(row[c] for c in order) for row in frame.collect()), key=repr)
    assert got == expected


def test_queries_without_twin_return_rows(spark):
    for name in sorted(set(QUERIES) - set(TWINS)):
        assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).columns == [
        "doc_id", "chunk_number", "chunk_text", "overlap_text", "character_start_offset", "character_end_offset",
    ]
