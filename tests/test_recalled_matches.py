"""Matches counted from the index of words are those of comparing each recalled pair's texts, and move no texts of lines."""

import random

from pyspark.sql import functions as F

from evidra.operators import retrieval
from evidra.plans import catalog


def test_counted_matches_are_those_of_the_texts(spark):
    draw = random.Random(3)
    words = ["the", "should", "of", "a", "is it", "Alpha", "alphabet", "river-bank", "rivers", "naïve", "éa bé", "x", "xy", "bridges", "bridge", "which", "(bridge)", "Ann", "an"]
    said = lambda n: " ".join(draw.choice(words) for _ in range(n))
    asked = spark.createDataFrame([(i, said(draw.randint(0, 7))) for i in range(40)] + [(40, "of a"), (41, "the should which")], "query_id long, text string")
    lines = spark.createDataFrame([(i // 10, i % 10, said(draw.randint(3, 12))) for i in range(120)], "doc_id long, pos int, text string")
    pairs = retrieval.keyword_recall(asked, lines).join(lines, ["doc_id", "pos"]).join(asked.withColumnRenamed("text", "question"), "query_id")
    match = retrieval.text_match(retrieval.question_parts(F.col("question")), retrieval.line_parts(F.col("text")))
    want = sorted(map(tuple, pairs.select("query_id", "doc_id", "pos", match.alias("match")).collect()))
    assert sorted(map(tuple, retrieval.recalled_matches(asked, lines).select("query_id", "doc_id", "pos", "match").collect())) == want and len(want) > 500


def test_texts_of_lines_move_once(spark):
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.queries()["text_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert plan.count("REPARTITION_BY_NUM") == 1 and "SortMergeJoin" not in plan
