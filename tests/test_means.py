"""Means of hits' scores go the way of the SQL, which adds doubles in the order of the table, also where they lie at a half."""

import os

import duckdb
import pytest

from evidra.plans import catalog

DATA = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("parts", [1, 7])
def test_scores_are_added_in_order(spark, tmp_path, parts):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(parts, "value").write.parquet(str(tmp_path / "events.parquet"))
    found = catalog.queries()["retrieval_stats"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute("SET threads = 1")
    duck.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{DATA}/events.parquet')")
    assert sorted(map(tuple, found.collect())) == sorted(duck.execute(catalog.oracle_sql()["retrieval_stats"]).fetchall())
