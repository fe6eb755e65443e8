import random
import zlib

import numpy as np
import pytest

from evidra.llm.toxicity import Scorer, Trees, features, fit_scorer, isotonic, score_toxicity, undone

BAD = ["grobnik", "flarpent", "zotterish", "mukelade"]


def corpus(n=600):
    r = random.Random(4)
    plain = [f"{a}{b}" for a in ("ver", "lo", "min", "ta", "ruse") for b in ("den", "mik", "sol", "par", "ne", "u")]
    rows = []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.randint(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(r.randint(2, 5)):
                words.insert(r.randrange(len(words)), "you " + r.choice(BAD))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy(spark, make_docs):
    rows = corpus()
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    docs = make_docs([(i, t, "s") for i, t, _ in rows] + [(1000, None, "s"), (1001, "", "s"), (None, "x", "s")])
    got = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 80 and all(got[i].predicted == rows[i][2] for i in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[1000].score == got[1001].score < 0.5


def test_labels_of_the_held_out_part_are_not_read(spark, make_docs):
    rows = corpus(200)
    flipped = [(i, 1, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows]
    docs = make_docs([(i, t, "s") for i, t, _ in rows])
    kind = "doc_id long, quality int, toxic int"
    a, b = (sorted(score_toxicity(docs, spark.createDataFrame(x, kind)).collect()) for x in ([(i, 1, y) for i, _, y in rows], flipped))
    assert a == b


def test_without_both_kinds_the_share_is_the_score(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in score_toxicity(make_docs([(1, "a", "s")]), none).collect()] == [0.0]
    assert score_toxicity(make_docs([]).limit(0), none).count() == 0
    assert Scorer([("a", 1)] * 3)("b") == 1.0


def test_obfuscation_is_undone():
    assert undone("gr0bn1k") == "grobnik" and undone("f.l.a.r.pent") == "flarpent"


def test_isotonic_rises():
    r = np.random.default_rng(0)
    x = r.random(200)
    knots, values = isotonic(x, (r.random(200) < x).astype(float))
    assert all(a <= b for a, b in zip(knots, knots[1:], strict=False)) and 0 < min(values) and max(values) < 1


def naive_score(scorer, text):
    """The score by recursion through the trees and a search for the knots around the sum."""

    def walk(tree, at, row):
        f, value, left, right = tree[at]
        return value if f < 0 else walk(tree, left if row[f] <= value else right, row)

    row = features(text, *scorer.lexicons)
    raw = scorer.trees.base + sum(walk(tree, 0, row) for tree in scorer.trees.trees)
    knots, values = list(scorer.knots), list(scorer.values)
    if raw <= knots[0] or raw >= knots[-1]:
        return values[0] if raw <= knots[0] else values[-1]
    i = max(k for k in range(len(knots)) if knots[k] <= raw)
    return values[i] + (values[i + 1] - values[i]) * (raw - knots[i]) / (knots[i + 1] - knots[i])


def test_scores_by_walking_the_trees(spark, make_docs):
    rows = corpus()
    kind = "doc_id long, toxic int, score double, predicted int, text string, line string"
    labels = spark.createDataFrame([(i, y, 0.5, 1, "x", "y") for i, _, y in rows], kind)
    long = " ".join(t for _, t, _ in rows) * 4
    docs = make_docs([(i, t, "s") for i, t, _ in rows] + [(1000, None, "s"), (1001, long, "s"), (5, rows[5][1], "s"), (5, rows[5][1], "s")])
    docs = docs.withColumn("score", docs.n_chars).withColumn("toxic", docs.n_chars).withColumn("predicted", docs.text)
    got = score_toxicity(docs, labels).collect()
    scorer, texts = fit_scorer(docs, labels), {i: t for i, t, _ in rows} | {1000: None, 1001: long}
    assert len(got) == len(rows) + 4 and sum(r.doc_id == 5 for r in got) == 3
    assert all(abs(r.score - naive_score(scorer, texts[r.doc_id])) < 1e-9 for r in got)


def test_first_split_is_the_best_one():
    r = np.random.default_rng(1)
    x = np.round(r.normal(size=(80, 3)), 1)
    y = (x[:, 1] + 0.3 * r.normal(size=80) > 0.2).astype(float)
    fitted = Trees.fit(x, y, rounds=1, depth=1)
    p = y.mean()
    grad, h = y - p, p * (1 - p)

    def gain(left):
        part = lambda rows: grad[rows].sum() ** 2 / (h * rows.sum() + 1)
        return part(left) + part(~left)

    ((f, cut, left, right), *leaves) = fitted.trees[0]
    chosen = x[:, f] <= cut
    assert all(gain(x[:, g] <= c) <= gain(chosen) + 1e-9 for g in range(3) for c in np.quantile(x[:, g], np.linspace(0, 1, 33)[1:-1]))
    for at, rows in ((left, chosen), (right, ~chosen)):
        assert leaves[at - 1][:2] == (-1, pytest.approx(0.2 * grad[rows].sum() / (h * rows.sum() + 1)))


def test_isotonic_means_are_the_least_squares_ones():
    r = np.random.default_rng(2)
    raw, y = np.sort(r.random(60)), (r.random(60) < np.linspace(0.1, 0.9, 60)).astype(float)
    mean = lambda j, k: y[j : k + 1].mean()
    fit = [max(min(mean(j, k) for k in range(i, 60)) for j in range(i + 1)) for i in range(60)]
    blocks = [[i for i in range(60) if abs(fit[i] - m) < 1e-12] for m in sorted({round(v, 12) for v in fit})]
    blocks = [b for b in blocks if b]
    knots, values = isotonic(raw, y)
    assert len(knots) == len(blocks)
    for b, at, value in zip(blocks, knots, values, strict=True):
        m = y[b].mean()
        assert at == pytest.approx(raw[b].mean()) and value == pytest.approx((m * len(b) + 0.5 * (0.02 + 0.96 * (m >= 0.5))) / (len(b) + 0.5))
