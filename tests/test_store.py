import pytest
from pyspark.sql import functions as F

from evidra.sources.store import DocumentStore, StoreConflict


@pytest.fixture
def store(spark, tmp_path):
    return DocumentStore(spark, str(tmp_path / "store"))


def rows(spark, values, name):
    return spark.createDataFrame(values, f"doc_id long, {name} string")


def seen(snapshot, part, **k):
    return sorted((r[0], r[1]) for r in snapshot.read(part, **k).collect())


def test_parts_become_visible_together(spark, store):
    assert store.snapshot().number == -1 and store.snapshot().documents().count() == 0
    store.save({"nodes": rows(spark, [(1, "a"), (2, "b")], "node"), "vectors": rows(spark, [(1, "v")], "v")})
    old = store.snapshot()
    failing = rows(spark, [(1, "w")], "v").withColumn("v", F.raise_error(F.lit("no model")))
    with pytest.raises(Exception, match="no model"):  # between the two writes
        store.save({"nodes": rows(spark, [(1, "changed")], "node"), "vectors": failing})
    assert store.snapshot().number == old.number and seen(store.snapshot(), "nodes") == [(1, "a"), (2, "b")]
    store.save({"nodes": rows(spark, [(1, "anew"), (3, "c")], "node")})
    now = store.snapshot()
    assert seen(now, "nodes") == [(1, "anew"), (2, "b"), (3, "c")] and seen(now, "vectors") == []  # 1 is replaced as a whole
    assert seen(now, "nodes", doc_id=1) == [(1, "anew")]
    with pytest.raises(KeyError):
        now.read("pictures")


def test_a_reader_keeps_its_snapshot(spark, store):
    store.save({"nodes": rows(spark, [(1, "a"), (2, "b")], "node")})
    reader = store.snapshot()
    pending = reader.read("nodes")  # not run yet
    store.save({"nodes": rows(spark, [(1, "later")], "node")})
    store.delete(rows(spark, [(2, "")], "x"))
    assert sorted(map(tuple, pending.collect())) == [(1, "a"), (2, "b")] == seen(reader, "nodes")
    assert seen(store.snapshot(), "nodes") == [(1, "later")] and [r[0] for r in store.snapshot().documents().collect()] == [1]
    assert seen(store.snapshot(0), "nodes") == [(1, "a"), (2, "b")]


def test_of_two_writers_one_tries_again(spark, store):
    base = store.snapshot()
    store.save({"nodes": rows(spark, [(1, "first")], "node")}, base)
    with pytest.raises(StoreConflict):
        store.save({"nodes": rows(spark, [(1, "second")], "node")}, base)
    assert seen(store.snapshot(), "nodes") == [(1, "first")]


def test_compact_clear_vacuum(spark, store):
    for i in range(3):
        store.save({"nodes": rows(spark, [(1, f"n{i}"), (i + 10, "x")], "node"), "meta": rows(spark, [(1, f"m{i}")], "m")})
    store.delete(rows(spark, [(11, "")], "x"))
    before = seen(store.snapshot(), "nodes"), seen(store.snapshot(), "meta")
    assert before == ([(1, "n2"), (10, "x"), (12, "x")], [(1, "m2")])
    small = store.compact()
    assert len(small.generations) == 1 and (seen(small, "nodes"), seen(small, "meta")) == before
    assert store.vacuum() == 4 and (seen(store.snapshot(), "nodes"), seen(store.snapshot(), "meta")) == before
    assert store.clear().documents().count() == 0 and store.snapshot().generations == []
    store.save({"nodes": rows(spark, [(5, "again")], "node")})
    assert seen(store.snapshot(), "nodes") == [(5, "again")]
