"""Every registered query with SQL is compared with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from rollmark import registry

DATA = os.environ.get("ROLLMARK_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    frame = registry.QUERIES[name](spark, DATA)
    wanted = duck.sql(registry.ORACLES[name])
    columns = sorted(frame.columns)
    assert columns == sorted(wanted.columns)
    got = sorted(tuple(plain(row[c]) for c in columns) for row in frame.collect())
    expected = sorted(tuple(map(plain, row)) for row in wanted.select(*[f'"{c}"' for c in columns]).fetchall())
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).limit(3).count() > 0


def test_every_sql_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
