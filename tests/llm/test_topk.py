import math

import numpy as np
import pytest

from evidra.llm.topk import pruned_share, search


def brute(rows, is_query, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault(i, []).append([math.floor(256 * float(np.float32(x))) for x in v])
    out = []
    for q, vectors in good.items():
        if is_query(np.array([q]))[0]:
            for a in vectors:
                scores = [(-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, bs in good.items() if i != q for b in bs]
                out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.1, 1.0, 300.0])
def test_equals_brute_force(spark, spread):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16))
    rows = [(int(i), [float(x) for x in centres[i % 6] + rng.normal(size=16) * spread]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # a large group of copies
    rows += [(1000, rows[0][1])] * 3 + [(1003, rows[7][1])] * 7 + [(3, rows[0][1])]  # repeated ids
    rows += [(5000, None), (5001, []), (5002, [None] * 16), (5003, [math.nan] * 16), (5004, [math.inf] * 16), (None, rows[1][1]), (5005, [0.5] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS pivot", "'x' AS v", "2 AS d")
    got = search(df, lambda ids: ids % 10 == 0, n_pivots=8, block=32, chunk=16)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda ids: ids % 10 == 0, 5)


def test_few_rows_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    every = lambda ids: ids >= 0
    assert search(spark.createDataFrame([], kind), every).count() == 0
    assert search(spark.createDataFrame([(1, [1.0])], kind), lambda ids: ids < 0).count() == 0
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [-1.0, 2.0])]
    assert sorted(map(tuple, search(spark.createDataFrame(rows, kind), every).collect())) == brute(rows, every, 5)


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-(10**6), 10**6, 8)]) for i in range(60)]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda ids: ids < 5, n_pivots=4, block=8)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda ids: ids < 5, 5)


def test_clusters_are_pruned(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 8))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    rows = [(i, [float(x) for x in centres[i % 20] + rng.normal(size=8) * 0.02]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    every = lambda ids: ids % 50 == 0
    assert pruned_share(df, every) > 0.5
    assert sorted(map(tuple, search(df, every).collect())) == brute(rows, every, 5)


def test_too_large_numbers_fail(spark):
    df = spark.createDataFrame([(0, [1e30]), (1, [1.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        search(df, lambda ids: ids < 5).collect()
