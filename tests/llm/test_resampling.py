import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.llm.resampling import Tournament, draw, drawn_documents, features, merged_runs, resample


def brute(docs, target, min_words=20, percent=10, words=1, buckets=10_000):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) pairs, from the definition."""

    def found(text):
        plain = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", plain)
        return len(w), [zlib.crc32(" ".join(w[i : i + words]).encode()) % buckets for i in range(len(w) - words + 1)]

    held = [(i, *found(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in held for b in f), Counter(b for x in target for b in found(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    rows = []
    for i, n, f in held:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], -(2**63) if r[0] is None else r[0]))
    for rank, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = rank + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def texts(n, seed=1):
    rng = random.Random(seed)
    known = ["alpha", "Beta", "gamma", "été", "don't", "x1", "中文", "ÉTÉ", "z" * 50] + [f"w{i}" for i in range(200)]
    return [(i, " ".join(rng.choice(known) for _ in range(rng.randint(0, 80)))) for i in range(n)]


@pytest.mark.parametrize("words", [1, 2])
def test_equals_brute_force(spark, make_docs, words):
    docs = texts(300) + [(1000, None), (1001, ""), (1002, " .,"), (1003, "long " * 50_000)]
    docs += [(7, docs[7][1])] * 2 + [(5, docs[9][1]), (None, docs[11][1])]  # repeated ids, and none
    target = ["alpha beta gamma w1 w2 w3 w4", None, "", "x1 x1 été"]
    made = make_docs([(i, t, "s") for i, t in docs]).selectExpr("*", "1 AS score", "2 AS weight", "3 AS row", "'x' AS buckets", "4 AS range")
    got = resample(made.repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), words=words, percent=30, block=8, ranges=4)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = brute(docs, target, words=words, percent=30)
    rows = [tuple(r) for r in got.collect()]
    assert sorted(r[:4] for r in rows if r[0] is not None) == sorted(r[:4] for r in want if r[0] is not None)
    assert sorted(rows, key=str) == want


def test_empty_tables(spark, make_docs):
    none, some = make_docs([]), make_docs([(1, "a b", "s"), (2, None, "s")])
    assert resample(none, some).count() == 0
    assert sorted(map(tuple, resample(some, none, min_words=1).collect()), key=str) == brute([(1, "a b"), (2, None)], [], min_words=1)
    assert drawn_documents(some, none, min_words=1, percent=100).select("doc_id").collect()[0][0] == 1


def test_equal_scores_and_one_huge_group(spark):
    keys = spark.range(5000).select(F.lit(7).cast("long").alias("score"), (F.col("id") % 3).alias("doc"), "id").withColumnRenamed("id", "row").repartition(6)
    rows = sorted(map(tuple, draw(keys, 1234, block=64, ranges=8).collect()), key=lambda r: r[1])
    assert [r[0] for r in rows] == [i for _, i in sorted((i % 3, i) for i in range(5000))][:1234]
    assert [r[1] for r in rows] == list(range(1, 1235))
    assert draw(keys, 0).count() == 0
    assert draw(keys, 10**6, ranges=3).count() == 5000


def test_tournament_merges_runs():
    rng = random.Random(4)
    for _ in range(30):
        runs = [sorted((rng.randint(0, 50), rng.random()) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 40))]
        blocks = sorted((r[i], r[i : i + 7]) for r in runs for i in range(0, len(r), 7))
        assert list(merged_runs((h, iter(b)) for h, b in blocks)) == list(heapq.merge(*runs))


def test_tournament_holds_open_blocks_only():
    tree = Tournament(2)
    assert [tree.enter((k,)) for k in (3, 1, 2)] and tree.keys[tree.winner] == (1,)
    tree.put(None)
    assert tree.keys[tree.winner] == (2,) and len(tree.free) == tree.places - 2


def test_features():
    assert features("Don't ÉTÉ x1_y 中文!") == (6, ["don", "t", "ÉtÉ", "x1", "y", "中文"])
    assert features("a b c", 2) == (3, ["a b", "b c"])
    assert features(None) == (0, [])
    assert np.array(features("A" * 100_000)[1]).tolist() == ["a" * 100_000]
