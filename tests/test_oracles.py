"""Every query that SQL can express gives the rows of its oracle, on the smallest tables; the others run."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from evidra.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(v[i]) for i in order) for v in values), key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    found = catalog.queries()[name](spark, DATA)
    got = rows(found.columns, found.collect())
    sql = catalog.oracle_sql().get(name)
    if sql:
        cursor = duck.execute(sql)
        assert got == rows([d[0] for d in cursor.description], cursor.fetchall())


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["query_id", "rank", "doc_id", "pos", "context", "citation_confidence"] and found.count() > 0
    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
