"""Queries on answers: facts, scores, arbitration, attribution, replies of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import rules
from evidra.functions.text import tenthousandths
from evidra.operators import answers, classify, questions
from evidra.plans import sql
from evidra.plans.catalog import query
from evidra.sources.views import table

_FACTS = r"""list_filter(list_transform(string_split(regexp_replace({s}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(trim(trim(x), '-•*'))), lambda x: length(x) > 10)""".format(s=sql.strip("text"))


@query(f"SELECT doc_id, len(f)::BIGINT AS n_facts, f[1] AS first_fact, array_to_string(f, '|') AS facts FROM (SELECT doc_id, {_FACTS} AS f FROM documents)")
def fact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of every text."""
    f = answers.facts(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(f).cast("long").alias("n_facts"), F.get(f, F.lit(0)).alias("first_fact"), F.array_join(f, "|").alias("facts"))


@query(f"SELECT conv_id, turn, {sql.any_of('lower(text)', rules.NO_EVIDENCE)} OR text = '' AS no_evidence FROM conversations")
def no_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that say they found nothing."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", classify.claims_no_evidence(F.col("text")).alias("no_evidence"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    asked = said.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    given = said.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(given, ["conv_id", "turn"])


@query()
def answer_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of replies in conversations; word boundaries differ between the engines' patterns."""
    score = answers.answer_score(F.col("answer"), F.size(answers.facts(F.col("answer"))), F.col("question"))
    return _pairs(spark, sf_dir).select("conv_id", "turn", score.alias("score"))


@query("""WITH s AS (SELECT event_id, (event_id * 37 % 1001)::BIGINT AS a, (event_id * 91 % 1001)::BIGINT AS b, event_id % 5 = 0 AS m, event_id % 10 = 0 AS au, event_id % 3 > 0 AS ae, event_id % 19 = 0 AS nd,
    event_id % 4 = 0 AS d, event_id % 9 < 4 AS mg, event_id % 8 < 4 AS fs FROM events),
  z AS (SELECT * EXCLUDE (a, b), CASE WHEN event_id % 11 = 0 THEN 0 WHEN event_id % 13 = 0 THEN 50 ELSE a END AS a, CASE WHEN event_id % 17 = 0 THEN 0 WHEN event_id % 7 = 0 THEN 50 ELSE b END AS b FROM s)
SELECT event_id, CASE WHEN au AND (NOT ae OR a <= 100) AND fs THEN 'document_failsafe'
  WHEN m AND a > 100 AND ae AND d THEN 'deep_analysis' WHEN m AND a > 100 THEN 'evidence_graph' WHEN m AND ae AND d THEN 'deep_analysis'
  WHEN NOT m AND nd AND a <= 100 AND ae AND d THEN 'deep_analysis'
  WHEN a <= 100 AND b <= 100 THEN CASE WHEN ae AND d THEN 'deep_analysis' WHEN b > a AND b > 0 THEN 'llm_direct' WHEN a > 0 THEN 'evidence_graph' ELSE 'none' END
  WHEN a <= 100 THEN CASE WHEN ae AND d THEN 'deep_analysis' ELSE 'llm_direct' END WHEN b = 0 THEN 'evidence_graph' WHEN a >= 550 AND a > b * 1.4 THEN 'evidence_graph'
  WHEN ae AND d THEN 'deep_analysis' WHEN mg THEN 'merged' WHEN a >= b THEN 'evidence_graph' ELSE 'llm_direct' END AS source_path,
  CASE WHEN a <= 100 THEN 'refused' ELSE 'ok' END AS evidence_status FROM z""")
def arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which path answers, over made-up scores and models that answer now and then."""
    e = F.col("event_id")
    a = F.when(e % 11 == 0, 0).when(e % 13 == 0, 50).otherwise(e * 37 % 1001)
    b = F.when(e % 17 == 0, 0).when(e % 7 == 0, 50).otherwise(e * 91 % 1001)
    text = lambda given: F.when(given, "some text")
    models = {"deep": text(e % 4 == 0), "merged": text(e % 9 < 4), "failsafe": text(e % 8 < 4)}
    path = answers.arbitrate(text(a > 0), a, text(b > 0), b, e % 5 == 0, e % 10 == 0, e % 3 > 0, **models)
    return table(spark, sf_dir, "events").select("event_id", path.alias("source_path"), answers.path_status(text(a > 0), a).alias("evidence_status"))


@query(f"""SELECT conv_id, turn, array_to_string(CASE WHEN turn % 2 = 0 THEN {sql.listed(rules.SUGGESTED_WITHOUT_MODEL)} WHEN len(q) = 0 THEN {sql.listed(rules.SUGGESTED_WITHOUT_REPLY)} ELSE q[1:4] END, '|') AS suggested
FROM (SELECT conv_id, turn, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {sql.strip("x")}), lambda x: contains(x, '?')) AS q FROM conversations)""")
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions to suggest; messages play the replies of a model, which every second turn goes without."""
    found = answers.suggestions(F.col("text"), F.col("turn") % 2 != 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(found, "|").alias("suggested"))


@query(f"""SELECT doc_id, least(4096, CASE WHEN n > 30 THEN floor(b * 135 / 100) WHEN n > 15 THEN floor(b * 115 / 100) ELSE b END)::BIGINT AS budget
FROM (SELECT doc_id, len({sql.words("text")}) AS n, CASE WHEN f >= 20 THEN 3200 WHEN f >= 12 THEN 2400 WHEN f >= 6 THEN 1800 ELSE 1400 END AS b FROM (SELECT doc_id, text, len({_FACTS}) AS f FROM documents))""")
def synthesis_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of an answer made of facts; every text is asked about its own facts."""
    budget = questions.synthesis_budget(F.col("text"), F.size(answers.facts(F.col("text"))))
    return table(spark, sf_dir, "documents").select("doc_id", budget.alias("budget"))


@query()
def fact_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of question and reply merged: an ordered fold."""
    merged = answers.merge_facts(answers.facts(F.col("question")), answers.facts(F.col("answer")))
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.size(merged).cast("long").alias("n_facts"), F.array_join(merged, "|").alias("facts"))


@query()
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far questions support the replies to them."""
    return _pairs(spark, sf_dir).select("conv_id", "turn", tenthousandths(answers.attribution(F.col("answer"), F.col("question"), F.lit(0.5))).alias("score"))


@query()
def fallback_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of replies that share most with their question."""
    evidence = _pairs(spark, sf_dir).select(F.concat_ws(".", "conv_id", "turn").alias("query_id"), "question", F.lit(1).alias("rank"), F.col("answer").alias("text"))
    return answers.fallback_sentences(evidence).select("query_id", "r", "sentence")


@query()
def label_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well labels of key-value lines name what benchmark questions ask for."""
    labels = table(spark, sf_dir, "region").select(F.explode(F.array(*map(F.lit, ["Author", "Published", "Journal name", "City", "Version", "Titles"]))).alias("label")).distinct()
    bench = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("who is the author and what year? "), F.col("text")).alias("question"))
    return bench.join(F.broadcast(labels), F.lit(True)).select("item_id", "label", tenthousandths(answers.label_matches(F.col("label"), F.col("question"))).alias("match"))


@query("""SELECT o_orderkey, 'x = ' || o_orderkey AS answer, '{"k": ' || o_orderkey || '}' AS json, 'b' || o_orderkey AS facts FROM orders""")
def reply_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a model's reply: without thoughts, its JSON, its facts."""
    key = F.col("o_orderkey").cast("string")
    reply = F.concat(F.lit("<think>first {no} then</think>x = "), key, F.lit("<reasoning>unclosed"))
    json = F.concat(F.lit('Sure: {"k": '), key, F.lit("} done"))
    facts = F.concat(F.lit("Text\nFACTS_USED:\n- b"), key, F.lit("\nrest"))
    return table(spark, sf_dir, "orders").select("o_orderkey", answers.without_thoughts(reply).alias("answer"), answers.first_json(json).alias("json"), F.array_join(answers.facts_used(facts), "|").alias("facts"))


@query()
def answer_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question, both paths, choice and grounding as one JSON object each: what an interface would return."""
    p = _pairs(spark, sf_dir).withColumn("facts", answers.facts(F.col("answer"))).withColumn("direct", F.lit(None).cast("string"))
    scored = p.withColumn("score", answers.answer_score(F.col("answer"), F.size("facts"), F.col("question"))).withColumn("direct_score", F.lit(0).cast("long"))
    path = answers.arbitrate(F.col("answer"), F.col("score"), F.col("direct"), F.col("direct_score"), questions.is_metadata(F.col("question")), questions.is_authorship(F.col("question")))
    grounding = F.create_map(*[F.lit(v) for pair in rules.GROUNDING.items() for v in pair])
    rows = scored.withColumn("source_path", path).withColumn("grounding", F.coalesce(grounding[F.col("source_path")], F.lit(0.5)))
    one = lambda text, score, facts: F.struct(text.alias("answer_text"), score.alias("score"), answers.path_status(text, score).alias("status"), facts.alias("facts"))
    none = F.array().cast("array<string>")
    view = F.struct(
        "question",
        answers.answer_of(F.col("source_path"), F.col("answer"), F.col("direct")).alias("answer"),
        "source_path",
        "grounding",
        one(F.col("answer"), F.col("score"), F.col("facts")).alias("path_a"),
        one(F.col("direct"), F.col("direct_score"), none).alias("path_b"),
        answers.merge_facts(F.col("facts"), none).alias("merged_facts"),
    )
    return rows.select("conv_id", "turn", F.to_json(view).alias("response"))
