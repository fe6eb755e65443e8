"""Queries on what a reader gets. Every line plays evidence for its own document as the question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import rules
from evidra.operators import answers, respond, retrieval
from evidra.plans import sql
from evidra.plans.catalog import query
from evidra.plans.documents import TYPED, typed_lines
from evidra.sources import views
from evidra.sources.views import table

_S = sql.strip("text")
_EVIDENCE = sql.SECTIONED + ", evidence AS (SELECT doc_id AS query_id, doc_id, pos, page, section, text, ((pos * 37 + doc_id) % 101) / 100.0::DOUBLE AS alignment_score FROM sectioned)"
_RANKED = ", ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY alignment_score DESC, doc_id, pos)::INTEGER AS rank FROM evidence QUALIFY rank <= 15)"
_CITED = f""", once AS (SELECT * FROM evidence WHERE {_S} <> '' QUALIFY row_number() OVER (PARTITION BY query_id, page, section, left({_S}, 50) ORDER BY alignment_score DESC, doc_id, pos) = 1),
  cited AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY alignment_score DESC, doc_id, pos)::INTEGER AS rank FROM once)"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.sectioned(views.dealt_lines(table(spark, sf_dir, "documents")))
    return lines.select(F.col("doc_id").alias("query_id"), "doc_id", "pos", "page", "section", "text", ((F.col("pos") * 37 + F.col("doc_id")) % 101 / 100).alias("alignment_score"))


@query(f"WITH {_EVIDENCE}{_CITED} SELECT query_id, rank, pos FROM cited")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of each answer."""
    return respond.citations(_evidence(spark, sf_dir)).select("query_id", "rank", "pos")


@query(f"""WITH {_EVIDENCE}{_CITED}, c AS (SELECT query_id, avg(floor(least(1.0, 0.40 * alignment_score + 0.30 + 0.20 * 0.5 + 0.10) * 1000 + 0.5 + 1e-9)) / 1000 AS c FROM cited GROUP BY query_id),
  a AS (SELECT query_id, avg(alignment_score) AS a, count(*) AS n FROM evidence GROUP BY query_id)
SELECT query_id, floor(coalesce(c, 1.0) * 1000 + 0.5 + 1e-6)::BIGINT AS overall, floor(a * 1000 + 0.5 + 1e-6)::BIGINT AS semantic_alignment, 1000::BIGINT AS source_grounding, floor(least(n / 10, 1.0) * 1000 + 0.5 + 1e-6)::BIGINT AS evidence_coverage
FROM a LEFT JOIN c USING (query_id)""")
def confidence_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of each answer by its parts."""
    evidence = _evidence(spark, sf_dir)
    cited = respond.citations(evidence).withColumn("citation_confidence", retrieval.citation_confidence(F.col("alignment_score"), F.lit(1.0), F.lit(None).cast("double"), F.lit(False)))
    return respond.confidence_breakdown(evidence, cited)


@query(f"WITH {_EVIDENCE}{_RANKED} SELECT query_id, rank, left({_S}, 500) AS text, page, section FROM ranked WHERE {_S} <> ''")
def raw_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first evidence of each question as it is shown."""
    return respond.raw_view(_evidence(spark, sf_dir))


@query(f"""WITH {_EVIDENCE}{_RANKED}, n AS (SELECT *, 'evidence:' || doc_id || ':' || pos AS item FROM ranked), l AS (SELECT *, lead(item) OVER (PARTITION BY query_id, doc_id, page ORDER BY rank) AS after FROM n)
SELECT query_id, 'query:' || query_id AS src, item AS dst, 'RETRIEVES' AS relationship FROM n UNION ALL SELECT query_id, 'section:' || doc_id || ':' || section, item, 'CONTAINS' FROM n
UNION ALL SELECT query_id, item, after, 'ADJACENT' FROM l WHERE after IS NOT NULL""")
def evidence_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the picture of each answer."""
    return respond.subgraph(_evidence(spark, sf_dir))


@query(f"""WITH {sql.LINES}, t AS (SELECT doc_id, pos, {_S} AS t, sum(length({_S})) OVER (PARTITION BY doc_id ORDER BY pos) AS total FROM lines WHERE {_S} <> '')
SELECT doc_id, string_agg(t, ' ' ORDER BY pos) AS text FROM t WHERE total <= 3000 GROUP BY doc_id""")
def budget_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beginning of every document within 3000 characters."""
    return respond.budget_text(views.lines(table(spark, sf_dir, "documents")), 3000, "doc_id")


@query(f"""WITH {sql.SECTIONED}, z AS (SELECT doc_id, section, sum(length(text))::BIGINT AS n_chars FROM sectioned GROUP BY ALL)
SELECT doc_id, section, n_chars, row_number() OVER (PARTITION BY doc_id ORDER BY n_chars DESC, section)::INTEGER AS rank FROM z QUALIFY rank <= 5""")
def longest_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five longest sections of every document."""
    return respond.longest_sections(views.sectioned(views.lines(table(spark, sf_dir, "documents"))))


_SCORE = f"""CASE WHEN page <= 2 THEN 4 ELSE 0 END + CASE WHEN information_type IN ('metadata', 'fact', 'header') THEN 3 ELSE 0 END + CASE WHEN {sql.any_of(f"lower({_S})", rules.AUTHORSHIP_TERMS)} THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches({_S}, {sql.text(rules.EMAIL)}) THEN 2 ELSE 0 END + CASE WHEN len({sql.words(_S)}) BETWEEN 2 AND 24 THEN 1 ELSE 0 END"""


@query(f"""WITH {sql.LINES}{TYPED}, s AS (SELECT doc_id, pos, page, {_S} AS t, {_SCORE} AS score FROM typed WHERE {_S} <> ''),
  o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, lower(left(t, 120)) ORDER BY score DESC, page, length(t) DESC, pos) = 1),
  b AS (SELECT *, '[Page ' || page || '] ' || t AS line, row_number() OVER w AS rank, sum(length('[Page ' || page || '] ' || t) + 1) OVER w AS total FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, page, length(t) DESC, pos))
SELECT doc_id, rank::INTEGER AS rank, pos, line FROM b WHERE total <= 9000 AND rank <= 45""")
def authorship_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that tell who made a document."""
    return respond.authorship_context(typed_lines(spark, sf_dir))


@query()
def fact_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence that fits each fact of a document best."""
    facts = views.whole_texts(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("query_id"), F.posexplode(answers.facts(F.col("text"))).alias("nth", "fact"))
    return respond.attribute_facts(facts, _evidence(spark, sf_dir)).drop("fact")


@query()
def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities read off 'Priority: value' lines of orders; label scores depend on many synonyms."""
    lines = views.fact_lines(spark, sf_dir)
    evidence = lines.select(F.col("section").alias("query_id"), "doc_id", "pos", "text", F.lit(0.5).alias("alignment_score"))
    asked = spark.createDataFrame([("Which priority has the order?",)], "question string")
    asked = asked.select("question", answers.hint_words(F.col("question")).alias("hints"), answers.expanded_hints(F.col("question")).alias("expanded_hints"))
    evidence = evidence.crossJoin(F.broadcast(asked))
    return respond.extractive_answers(evidence, answers.label_matches(F.col("label"), F.col("question"), F.col("expanded_hints")))


@query("SELECT event_id, 6::BIGINT AS n_steps, CASE WHEN event_id % 4 = 0 THEN 'empty' ELSE 'done' END AS arbitrated FROM events")
def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of made-up questions."""
    log = respond.step_log(F.when(F.col("event_id") % 4 == 0, "none").otherwise("merged"), F.col("event_id") % 3)
    return table(spark, sf_dir, "events").select("event_id", F.size(log).cast("long").alias("n_steps"), log[4]["status"].alias("arbitrated"))
