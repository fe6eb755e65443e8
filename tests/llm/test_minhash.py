import random
from collections import Counter

import numpy as np

from evidra.llm.minhash import _named, _together, dart_signature, dart_signatures, drop_near_duplicates, mixed, near_duplicate_classes


def shingles(text):
    w = (text or "").lower().encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def similarity(a, b):
    return (a & b).total() / (a | b).total()


def brute(rows):
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and similarity(sets[a], sets[b]) >= 0.8:
                root[find(a)] = find(b)
    best = {}
    for a, (i, _, _) in enumerate(rows):
        best[find(a)] = min((x for x in (best.get(find(a)), i) if x is not None), default=None)
    return sorted((i, i if sets[a] is None else best[find(a)]) for a, (i, _, _) in enumerate(rows))


def corpus(seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 5, 8, 60, 200]))]
        for edits in (0, 0, 1, 2, 5, 12, 30)[: r.randint(1, 7)]:
            words = list(base)
            for _ in range(edits):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            rows.append((n, " ".join(words).upper() if n % 5 == 0 else "  ".join(words), "s"))
            n += 1
    for repeats in (1, 2, 10, 11, 12, 14):  # one passage, more and less often: the counts decide
        rows.append((n, " ".join(vocabulary[:30] * repeats), "s"))
        n += 1
    return rows


def test_classes_are_the_components(make_docs):
    rows = corpus() + [(1000, None, "s"), (1001, "", "s"), (1002, " \t", None)]
    got = sorted((r.doc_id, r.class_id) for r in near_duplicate_classes(make_docs(rows)).collect())
    assert got == brute(rows)


def test_block_pairs_find_what_leaders_miss(make_docs):
    # A group of near copies at the edge of the threshold, in blocks of three rows and without rounds of leaders.
    r = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(2):
            words[r.randrange(120)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(words), "s"))
    got = sorted((x.doc_id, x.class_id) for x in near_duplicate_classes(make_docs(rows), rounds=0, block=3).collect())
    assert got == brute(rows)


def test_one_of_each_class_stays(make_docs):
    rows = corpus(4) + [(0, corpus(4)[0][1], "s")]
    docs = make_docs(rows)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in brute(rows)})
    assert drop_near_duplicates(make_docs([]).limit(0)).count() == 0


def test_texts_of_one_id_stay_apart(make_docs):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, one, "s"), (1, two, "s"), (2, one + " end", "s"), (3, two + " end", "s"), (1, "", "s"), (1, " ", "s")]
    kept = sorted((r.doc_id, r.text) for r in drop_near_duplicates(make_docs(rows)).collect())
    assert kept == sorted([(1, one), (1, two), (1, ""), (1, " ")])


def test_rows_without_id_or_words_stay(make_docs):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(5, None, "s"), (5, None, "s"), (5, "", "s"), (5, "", "s"), (None, one, "s"), (None, two, "s"), (None, one + " end", "s"), (None, None, "s")]
    docs = make_docs(rows)
    kept = sorted(((r.doc_id, r.text) for r in drop_near_duplicates(docs).collect()), key=str)
    assert len(kept) == 7 and kept.count((5, None)) == 2 and kept.count((5, "")) == 2 and (None, two) in kept
    named = near_duplicate_classes(docs).collect()
    assert [r.class_id for r in named if r.doc_id == 5] == [5] * 4
    assert len({r._ev_class for r in named if r._ev_class is not None}) == 2


def test_nodes_of_alike_prints_get_names_of_their_own(spark):
    rows = [(256, 1), (256, 2), (257, 1), (511, 9), (512, 1), (-1, 4), (-2, 4)]
    named = {(r.p1, r.p2): r.node for r in _named(spark.createDataFrame(rows, "p1 long, p2 long")).collect()}
    assert len(set(named.values())) == len(rows) and named[512, 1] == 512


def test_long_texts_are_taken_in_pieces():
    rng = np.random.default_rng(1)
    elements = mixed(rng.integers(0, 2**63, 700_000, dtype=np.uint64))
    whole = dart_signatures(elements, np.zeros(len(elements), np.int64), 1)[0]
    assert (_together([elements[:50], elements], 120)[1] == whole[0]).all()


def test_recall_at_the_threshold(make_docs):
    r = random.Random(9)
    rows, n = [], 0
    for _ in range(150):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([40, 100, 300]))]
        for _ in range(2):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(words) // 60))):
                words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
            rows.append((n, " ".join(words), "s"))
            n += 1
    got = {x.doc_id: x.class_id for x in near_duplicate_classes(make_docs(rows)).collect()}
    close = [a for a in range(0, n, 2) if similarity(shingles(rows[a][1]), shingles(rows[a + 1][1])) >= 0.8]
    assert len(close) > 80 and sum(got[a] == got[a + 1] for a in close) >= 0.99 * len(close)
    assert all(got[a] != got[a + 1] for a in range(0, n, 2) if a not in close)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    elements = mixed(rng.integers(0, 2**63, 300, dtype=np.uint64))
    light = rng.random(300) * 3 + 0.1
    heavy = light * rng.random(300)
    want = np.minimum(light, heavy).sum() / np.maximum(light, heavy).sum()
    assert abs((dart_signature(elements, light, 4000) == dart_signature(elements, heavy, 4000)).mean() - want) < 0.03
    coordinates = Counter(dart_signature(elements, k=1000).tolist())
    assert max(coordinates.values()) == 1  # a dart names one coordinate
