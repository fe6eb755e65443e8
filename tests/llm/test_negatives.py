import math

import numpy as np
import pytest

from evidra.llm.negatives import Grid, mine, window

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    good = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v], label)
        for i, v, label in rows
        if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, x, label in good:
        if not is_anchor(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=False)), i, m) for i, y, m in good)
        for s, p, _ in [t for t in scored if t[2] == label and t[1] != a][:positives]:
            hard = [t for t in scored if t[2] != label and low * -s <= 100 * -t[0] <= high * -s][:negatives]
            out += [(a, p, r + 1, j, -s, -t) for r, (t, j, _) in enumerate(hard)]
    return sorted(out)


def rows_of(spread, n=300, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 12))
    return [(int(i), [float(x) for x in centres[i % 5] + rng.normal(size=12) * spread], int(rng.integers(4))) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 1.0, 300.0])
def test_equals_brute_force(spark, spread):
    rows = rows_of(spread)
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(120)]  # a large group of copies
    rows += [(2000 + i, rows[0][1], (rows[0][2] + 1) % 4) for i in range(40)]  # and of copies with another label
    rows += [(10, rows[0][1], 1)] * 2 + [(1003, rows[7][1], 2)] * 7  # repeated ids
    rows += [(5000, None, 1), (5010, [], 1), (5020, [None] * 12, 1), (5030, [math.nan] * 12, 1), (5040, [math.inf] * 12, 1), (None, rows[1][1], 1), (5050, [0.5] * 9, 2), (5060, rows[2][1], None)]
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS block", "'x' AS v", "2 AS d", "3 AS chunk")
    got = mine(df, lambda ids: ids % 10 == 0, block=32, chunk=16, cells=8)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 300
    assert sorted(map(tuple, got.collect())) == want


def test_few_rows_and_none(spark):
    every = lambda ids: ids >= 0
    assert mine(spark.createDataFrame([], KIND), every).count() == 0
    assert mine(spark.createDataFrame([(1, [1.0], None)], KIND), every).count() == 0
    assert mine(spark.createDataFrame([(1, [1.0], 0)], KIND), lambda ids: ids < 0).count() == 0
    rows = [(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 0), (3, [0.7, 0.0], 1), (4, [0.7, 0.0], 1), (5, [-1.0, 0.0], 1)]
    got = sorted(map(tuple, mine(spark.createDataFrame(rows, KIND), every).collect()))
    assert got == brute(rows, lambda i: True) and got


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-(10**6), 10**6, 8)], int(rng.integers(2))) for i in range(80)]
    got = mine(spark.createDataFrame(rows, KIND), lambda ids: ids < 9, block=16)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i < 9)


def test_windows_hold_their_ends():
    for s in range(-200, 400):
        least, most = window(s)
        assert [t for t in range(-500, 500) if 50 * s <= 100 * t <= 95 * s] == list(range(least, most + 1))


@pytest.mark.parametrize("cells", [2, 16, 256])
def test_bounds_hold_and_tighten(cells):
    rng = np.random.default_rng(1)
    x = rng.integers(-120, 120, (500, 24))
    grid = Grid(x[:50], x.min(0), x.max(0), cells, "<i2")
    codes = grid.codes(x)
    dims = np.arange(24)
    assert (grid.low[dims, codes] <= x).all() and (x <= grid.high[dims, codes]).all()
    lower, upper = grid.bounds(x[:20], codes)
    exact = x[:20] @ x.T
    assert (lower <= exact).all() and (exact <= upper).all()
    tables = [[np.minimum(q[d] * grid.low[d], q[d] * grid.high[d])[codes[:, d]] for d in range(24)] for q in x[:20]]
    assert (lower == np.array(tables).sum(1)).all()  # the same as looking up a query's own table
