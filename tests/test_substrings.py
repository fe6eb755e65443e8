import random
import time

from evidra.operators import claims
from evidra.operators.substrings import contained


def brute(needles, texts):
    return sorted({(k, n, t) for k, n in needles for j, t in texts if k == j and n and t is not None and n in t}, key=str)


def test_random_texts(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcé ") for _ in range(rng.randint(0, n)))
    needles = [(rng.randint(0, 3), word(7)) for _ in range(200)] + [(1, None), (1, ""), (9, "abc")]
    texts = [(rng.randint(0, 3), word(25)) for _ in range(150)] + [(1, None), (1, ""), (2, "abc")] * 2
    made = lambda rows, name: spark.createDataFrame(rows, f"key long, {name} string").selectExpr("*", "1 AS gram", "2 AS n", "3 AS r")
    for q in (2, 4):
        got = contained(made(needles, "needle"), made(texts, "text"), "key", q=q)
        assert got.columns == ["key", "needle", "text"]
        assert sorted(map(tuple, got.collect()), key=str) == brute(needles, texts)


def test_a_document_of_many_claims_finishes(spark):
    """100,000 claims of one document; compared pair by pair they would be 5e9."""
    values = "concat('order ', lpad(cast(id * 7919 % 1000003 as string), 7, '0'), ' of ', cast(id as string))"
    rows = spark.range(100_000).selectExpr("1L AS doc_id", "id + 1 AS claim_no", f"CASE WHEN id % 1000 = 0 THEN substr({values}, 1, 13) ELSE {values} END AS value", "'x' AS claim_type")
    began = time.perf_counter()
    assert claims.linked(rows).where("b_claim_no <= a_claim_no").count() == 0
    assert time.perf_counter() - began < 120


def test_links_hold_their_case(spark):
    rows = [(1, 1, "Alpha", "x"), (1, 2, "The Alpha", "x"), (1, 3, "the alpha", "x"), (1, 4, "Alpha", "x"), (2, 1, "Alpha and", "x"), (1, 5, "Alph", "x"), (1, 6, "Alph", "x")]
    found = claims.linked(spark.createDataFrame(rows, "doc_id long, claim_no long, value string, claim_type string"))
    assert sorted((r[1], r[2]) for r in found.collect()) == [(1, 2), (1, 4)]


def test_the_last_definition_counts(spark):
    rows = [(1, 1, "AI = a field", "fact_definition"), (1, 2, "about ai", "x"), (1, 3, "ai = another", "fact_definition"), (1, 4, "none", "x")]
    found = claims.depends(spark.createDataFrame(rows, "doc_id long, claim_no long, value string, claim_type string"))
    assert sorted(map(tuple, found.collect())) == [(1, 1, 3), (1, 2, 3)]


def test_needles_meet_only_longer_texts(spark):
    """Values of one length can only be equal, so no grams of them are posted: needles equal to a text are found all the same."""
    rows = [(1, f"2024-01-{d:02d}") for d in range(10, 30)] * 2 + [(2, "ab"), (2, "abc"), (3, "zz")]
    needles, texts = spark.createDataFrame(rows, "key long, needle string"), spark.createDataFrame(rows[:-1], "key long, text string")
    got = contained(needles, texts, "key")
    assert sorted(map(tuple, got.collect())) == brute(rows, rows[:-1])
    alone = contained(needles.where("key = 1"), texts.where("key = 1"), "key")
    got = alone.collect()
    plan = alone._jdf.queryExecution().executedPlan().toString()
    assert len(got) == 20 and "explode" not in plan.split("== Initial Plan ==")[0]
