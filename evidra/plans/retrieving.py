"""Queries on questions: interpretation, recall, ranking, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import rules, seams
from evidra.functions.text import tenthousandths
from evidra.operators import claims, concepts, graph, layout, questions, ranking, retrieval, vectors
from evidra.operators import property_graph as graphs
from evidra.plans import sql
from evidra.plans.catalog import query
from evidra.plans.documents import TYPED, letter_vectors, noise, typed_lines, typed_of
from evidra.sources import views
from evidra.sources.scratch import written
from evidra.sources.views import table

_Q = sql.QUESTIONS
_LOW = "lower(text)"
_INTENT = sql.rule_chain(_LOW, rules.INTENTS, "'factual_lookup'")
_ANSWER = sql.rule_chain(_LOW, rules.ANSWER_TYPES, "'description'")


def _bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sectioned(views.dealt_lines(table(spark, sf_dir, "documents"))).withColumn("confidence", (F.lit(6) + F.col("pos") % 5) / 10)


@query(f"""WITH {_Q}, t AS (SELECT *, {_INTENT} AS intent, {_ANSWER} AS answer_type FROM questions)
SELECT query_id, intent, answer_type, intent IN ('comparative', 'summarization', 'causal') AS requires_reasoning, {sql.mapped("intent", rules.SEARCH_POOL, 35)}::INTEGER AS search_pool FROM t""")
def query_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent, answer type and pool of every question."""
    asked = views.questions(spark, sf_dir).select("query_id", questions.intent(F.col("text")).alias("intent"), questions.answer_type(F.col("text")).alias("answer_type"))
    return asked.select("*", questions.requires_reasoning(F.col("intent")).alias("requires_reasoning"), questions.search_pool(F.col("intent")).alias("search_pool"))


def _overlap(keywords: list[str]) -> str:
    return f"list_has_any({sql.tokens('text')}, {sql.listed(keywords)})"


@query(f"""WITH {_Q} SELECT query_id, {_overlap(rules.METADATA_KEYWORDS)} OR {sql.any_of(_LOW, rules.METADATA_PHRASES)} AS is_metadata,
  {_overlap(rules.AUTHORSHIP_KEYWORDS)} OR ({_overlap(["who", "name", "names"])} AND {_overlap(["made", "built", "created", "developed", "wrote", "written"])}) OR {sql.any_of(_LOW, rules.AUTHORSHIP_PHRASES)} AS is_authorship FROM questions""")
def query_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about the document itself and who made it."""
    text = F.col("text")
    return views.questions(spark, sf_dir).select("query_id", questions.is_metadata(text).alias("is_metadata"), questions.is_authorship(text).alias("is_authorship"))


_N = f"len({sql.words('text')})"


@query(f"""WITH {_Q}, t AS (SELECT *, {_INTENT} AS intent, {_ANSWER} AS answer_type FROM questions)
SELECT query_id, {_N} <= 12 AND (regexp_matches(trim(text), {sql.text(rules.FACTUAL_START)}) OR {sql.any_of(_LOW, rules.FACTUAL_KEYWORDS)} OR answer_type IN ('name', 'date', 'number', 'percentage', 'entity')
  OR (intent IN ('factual_lookup', 'definition') AND {_N} <= 8)) AS is_factual FROM t""")
def factual_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short questions that ask for one value."""
    text = F.col("text")
    return views.questions(spark, sf_dir).select("query_id", questions.is_factual(text, questions.intent(text), questions.answer_type(text)).alias("is_factual"))


_BASE = sql.mapped("intent", rules.TOKEN_BUDGETS, 1400)


@query(f"""WITH {_Q}, t AS (SELECT query_id, {_INTENT} AS intent, {_ANSWER} AS answer_type, {_N} AS n, length(text) % 20 AS evidence FROM questions), a AS (SELECT *, {_BASE} AS b FROM t),
  c AS (SELECT *, CASE WHEN n > 30 THEN floor(b * 14 / 10) WHEN n > 15 THEN floor(b * 12 / 10) ELSE b END AS c FROM a), d AS (SELECT *, CASE WHEN evidence >= 15 THEN floor(c * 125 / 100) WHEN evidence >= 8 THEN floor(c * 11 / 10) ELSE c END AS d FROM c)
SELECT query_id, least(4096, CASE WHEN answer_type IN ('list', 'explanation', 'summary') THEN greatest(d, 1800) ELSE d END)::BIGINT AS budget FROM d""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer length of every question; the number of evidence items is made up from its length."""
    text = F.col("text")
    return views.questions(spark, sf_dir).select("query_id", questions.token_budget(text, questions.intent(text), questions.answer_type(text), F.char_length(text) % 20).alias("budget"))


def _intents_sql() -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {sql.any_of(_LOW, t)} THEN {sql.text(k)} END" for k, t in rules.METADATA_TRIGGERS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {_Q} SELECT query_id, array_to_string({_intents_sql()}, '|') AS kinds FROM questions")
def metadata_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of metadata that questions ask for."""
    return views.questions(spark, sf_dir).select("query_id", F.array_join(questions.metadata_intents(F.col("text")), "|").alias("kinds"))


@query()
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities, claims and terms of every question; word boundaries differ between the engines' patterns."""
    text, joined = F.col("text"), (lambda c: F.array_join(c, "|"))
    return views.questions(spark, sf_dir).select(
        "query_id", joined(questions.key_entities(text)).alias("entities"), joined(questions.expanded_claims(text)).alias("claims"), joined(questions.expanded_terms(text)).alias("terms")
    )


#: Key entities of a question. Letters beyond ASCII become underscores, which bound a word as those letters do.
_ENTITIES = f"""list_filter(regexp_extract_all(regexp_replace(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_\\x00-\\x7F]', ' ', 'g'), '[^\\x00-\\x7F]', '_', 'g'), '\\b[A-Za-z][A-Za-z0-9-]+\\b'),
  lambda w: length(w) > 2 AND NOT list_contains({sql.listed(rules.ENTITY_STOP)}, lower(w)))[1:8]"""

_TERMS = f"""said AS (SELECT item_id AS query_id, {sql.tokens("text")} AS w, {_ENTITIES} AS en FROM benchmark),
  terms AS (SELECT DISTINCT query_id, unnest(w) AS term FROM said),
  named AS (SELECT DISTINCT query_id, term, 1 AS n FROM (SELECT query_id, unnest({sql.tokens("array_to_string(en, ' ')")}) AS term FROM said) WHERE length(term) > 2),
  kept AS (SELECT query_id, term, coalesce(n, 0) AS n FROM (SELECT query_id, term FROM terms WHERE length(term) > 2 AND NOT list_contains({sql.listed(rules.RECALL_STOP)}, term) UNION SELECT query_id, term FROM named) LEFT JOIN named USING (query_id, term)),
  stems AS (SELECT DISTINCT query_id, unnest([CASE WHEN length(term) >= 4 THEN left(term, 4) END, CASE WHEN length(term) >= 5 THEN left(term, 5) END]) AS stem FROM kept),
  lt AS (SELECT DISTINCT doc_id, pos, unnest({sql.tokens("text")}) AS term FROM lines WHERE length(text) >= 15),
  ls AS (SELECT DISTINCT doc_id, pos, unnest([CASE WHEN length(term) >= 4 THEN left(term, 4) END, CASE WHEN length(term) >= 5 THEN left(term, 5) END]) AS stem FROM lt),
  hits AS (SELECT query_id, doc_id, pos, 1 AS e, n, 0 AS f FROM kept JOIN lt USING (term) UNION ALL SELECT query_id, doc_id, pos, 0, 0, 1 FROM stems JOIN ls USING (stem)),
  recall AS (SELECT query_id, doc_id, pos, least(55, 15 + sum(e) * 6 + sum(n) * 10 + sum(f) * 3) AS score100 FROM hits GROUP BY ALL HAVING sum(e) + sum(n) * 1.5 + sum(f) * 0.4 >= 1.5 OR sum(n) > 0)"""


@query(f"WITH {sql.LINES}, {_TERMS} SELECT query_id, doc_id, pos, score100::BIGINT AS score100 FROM recall")
def keyword_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that share words with benchmark questions."""
    found = retrieval.keyword_recall(_bench(spark, sf_dir), views.dealt_lines(table(spark, sf_dir, "documents")))
    return found.select("query_id", "doc_id", "pos", F.round(F.col("score") * 100).cast("long").alias("score100"))


def _scan_sql() -> str:
    s = sql.strip("text")
    meta = "coalesce(information_type = 'metadata', false)"
    parts = []
    for kind, patterns in rules.METADATA_PATTERNS.items():
        weak = f"information_type IN ('metadata', 'fact') AND page <= 2 AND len({sql.words(s)}) <= 15" if kind == "author" else f"{meta} AND page <= 2"
        parts.append(f"""SELECT doc_id, pos, '{kind}' AS kind, CASE WHEN {sql.any_match(s, patterns)} THEN least(100, CASE WHEN page <= 2 THEN 90 ELSE 65 END + CASE WHEN {meta} THEN 5 ELSE 0 END)
  WHEN {weak} THEN 45 END AS score FROM typed WHERE length({s}) >= 3""")
    return f"""WITH {sql.LINES}{TYPED}, {_Q}, i AS (SELECT query_id, unnest({_intents_sql()}) AS kind FROM questions), h AS ({" UNION ALL ".join(parts)})
SELECT query_id, doc_id, pos, max(score)::BIGINT AS score100 FROM i JOIN h USING (kind) WHERE score IS NOT NULL GROUP BY ALL"""


@query(_scan_sql())
def metadata_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that look like the metadata that questions ask for, of all nine kinds."""
    intents = views.questions(spark, sf_dir).select("query_id", F.explode(questions.metadata_intents(F.col("text"))).alias("kind"))
    found = retrieval.metadata_scan(intents, typed_lines(spark, sf_dir))
    return found.select("query_id", "doc_id", "pos", F.round(F.col("score") * 100).cast("long").alias("score100"))


@query(f"""WITH {sql.SECTIONED}, {_TERMS}, n AS (SELECT doc_id, pos, section, lead(pos) OVER o AS np, lead(section) OVER o AS ns FROM sectioned WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
  u AS (SELECT query_id, doc_id, pos, score100 * 100 AS s FROM recall UNION ALL SELECT query_id, r.doc_id, np, score100 * 95 FROM recall r JOIN n ON r.doc_id = n.doc_id AND r.pos = n.pos WHERE ns = section)
SELECT query_id, doc_id, pos, max(s)::BIGINT AS score FROM u GROUP BY ALL""")
def edge_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recalled lines and the lines after them, with the better score of both."""
    found = retrieval.keyword_counts(_bench(spark, sf_dir), graph.with_next(_lines(spark, sf_dir)), "next_pos")
    return retrieval.expand_next(found).select("query_id", "doc_id", "pos", F.round(F.col("score") * 10000).cast("long").alias("score"))


def _recalled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Recalled candidates of benchmark questions with the bounds of their matches, the questions, and all lines."""
    lines, bench = _lines(spark, sf_dir), _bench(spark, sf_dir)
    asked = bench.select("query_id", F.col("text").alias("question"), questions.intent(F.col("text")).alias("intent"))
    counted = retrieval.keyword_counts(bench, ranking.rated_lines(lines), *ranking.RATED)
    return ranking.most_match(counted, bench), asked, lines.select("doc_id", "pos", "section", "text", "confidence")


def _kept_sql(e: str) -> str:
    return f"list_distinct(list_filter({sql.tokens(e)}, lambda x: length(x) > 2))"


def _phrases_sql(k: int) -> str:
    return f"list_transform(range(1, len(w) - {k - 2}), lambda i: {{'k': {k}, 'p': array_to_string(w[i:i + {k - 1}], ' ')}})"


#: Parts of questions and lines, and the match of a recalled pair in ``r``.
_MATCH = f"""qp AS (SELECT query_id, kept AS qt, len(w) AS qn, list_filter(list_concat({_phrases_sql(2)}, {_phrases_sql(3)}, {_phrases_sql(4)}), lambda x: length(x.p) > 5) AS ph
    FROM (SELECT item_id AS query_id, {_kept_sql("text")} AS kept, {sql.words("lower(text)")} AS w FROM benchmark)),
  lp AS (SELECT doc_id, pos, {_kept_sql("text")} AS lt, lower(text) AS low FROM lines WHERE length(text) >= 15),
  m AS (SELECT r.*, qt, qn, list_intersect(qt, lt) AS shared, coalesce(list_max(list_transform(ph, lambda x: CASE WHEN contains(low, x.p) THEN x.k ELSE 0 END)), 0) AS best
    FROM recall r JOIN qp USING (query_id) JOIN lp USING (doc_id, pos)),
  matched AS (SELECT *, (CASE WHEN len(qt) = 0 THEN 0.0 ELSE least(1.0, len(shared) / len(qt) + best * 0.3 / qn + least(0.3, len(list_filter(shared, lambda x: length(x) >= 6)) * 0.1)) END)::DOUBLE AS text_match FROM m)"""


@query(f"WITH {sql.LINES}, {_TERMS}, {_MATCH} SELECT query_id, doc_id, pos, floor(text_match * 1000 + 0.5)::BIGINT AS text_match FROM matched")
def text_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of recalled lines with benchmark questions."""
    pairs = retrieval.recalled_matches(_bench(spark, sf_dir), views.dealt_lines(table(spark, sf_dir, "documents")))
    return pairs.select("query_id", "doc_id", "pos", F.floor(F.col("match") * 1000 + 0.5).cast("long").alias("text_match"))


_STRIPPED = sql.strip("text")
_CONSOLIDATED = f"""sec AS (SELECT query_id, doc_id, section, max(score100) AS best FROM recall JOIN sectioned USING (doc_id, pos) GROUP BY ALL),
  top3 AS (SELECT * FROM sec QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY best DESC, section) <= 3), asking AS (SELECT item_id AS query_id, {sql.rule_chain("lower(text)", rules.INTENTS, "'factual_lookup'")} AS intent FROM benchmark),
  worth AS (SELECT doc_id, pos, section, text, CASE WHEN {noise(_STRIPPED)} THEN 0.12 ELSE 0 END::DOUBLE AS noise,
    CASE WHEN length(text) > 120 THEN 0.06 WHEN length(text) > 60 THEN 0.03 ELSE 0 END::DOUBLE + CASE WHEN len({sql.words(_STRIPPED)}) >= 8 AND length(text) > 60 THEN 0.04 ELSE 0 END::DOUBLE AS added FROM sectioned),
  aligned AS (SELECT query_id, doc_id, pos, least(1.0, (0.7::DOUBLE * score100 / 100 + 0.3::DOUBLE * text_match - noise + CASE WHEN text_match > 0.5 AND score100 < 40 THEN 0.15 ELSE 0 END + added)
      * CASE WHEN intent IN ('summarization', 'comparative', 'enumerative', 'causal') OR t.section IS NOT NULL THEN 1.0 ELSE 0.85 END * pow((6 + pos % 5) / 10, 1.5)) AS score
    FROM matched JOIN worth USING (doc_id, pos) JOIN asking USING (query_id) LEFT JOIN top3 t USING (query_id, doc_id, section))"""


@query(f"""WITH {sql.SECTIONED}, {_TERMS}, {_MATCH}, {_CONSOLIDATED} SELECT query_id, doc_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id, pos)::INTEGER AS rank,
  floor(score * 10000 + 0.5)::BIGINT AS score FROM aligned QUALIFY rank <= 8""")
def consolidate_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best lines for each benchmark question; only those that may be among them are scored."""
    candidates, asked, lines = _recalled(spark, sf_dir)
    ready = written(ranking.prepared(candidates, asked, lines), "candidates")
    return ranking.best_by_bounds(ready, asked, lines, 8).select("query_id", "doc_id", "pos", "rank", tenthousandths(F.col("alignment_score")).alias("score"))


def _passages(chosen: DataFrame, lines: DataFrame) -> DataFrame:
    cited = retrieval.citation_confidence(F.col("alignment_score"), F.col("confidence"), F.lit(None).cast("double"), F.col("rank") <= 3)
    return retrieval.with_context(chosen, lines).select("query_id", "rank", "doc_id", "pos", "context", cited.alias("citation_confidence"))


@query()
def near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 best hits of each question when near repeats among all its hits, widened by the lines around them, are out."""
    return ranking.best_unlike(*_recalled(spark, sf_dir), 25).select("query_id", "rank", "doc_id", "pos")


@query()
def best_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that answer benchmark questions, with the confidence of their citation."""
    candidates, asked, lines = _recalled(spark, sf_dir)
    return _passages(ranking.best_unlike(candidates, asked, lines, 8), lines)


@query(f"""WITH {sql.SECTIONED} SELECT doc_id, pos, string_agg(text, ' ') OVER (PARTITION BY doc_id, section ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 4 FOLLOWING) AS context FROM sectioned""")
def context_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with the lines around it in its section."""
    return retrieval.contexts(_lines(spark, sf_dir))


#: What is searched for by similarity in the oracle: the question and its first five entities.
_CONTENT = lambda e: f"list_filter(list_distinct({sql.tokens(e)}), lambda w: length(w) > 2 AND NOT list_contains({sql.listed(rules.RECALL_STOP)}, w))"
_B_INTENT, _B_ANSWER = (sql.rule_chain("lower(text)", r, o) for r, o in ((rules.INTENTS, "'factual_lookup'"), (rules.ANSWER_TYPES, "'description'")))
_BOOST = " + ".join(
    "CASE " + " ".join(f"WHEN {c} = {sql.text(k)} AND information_type = {sql.text(t)} THEN {v}" for k, row in rules_.items() for t, v in row.items()) + " ELSE 0 END"
    for c, rules_ in (("intent", rules.INTENT_BOOSTS), ("answer_type", rules.ANSWER_BOOSTS))
)
_VECTOR = f"""asked AS (SELECT item_id AS query_id, text, {_B_INTENT} AS intent, {_B_ANSWER} AS answer_type, {_ENTITIES} AS en FROM benchmark),
  parts AS (SELECT query_id, 'c0' AS part, text, {sql.mapped("intent", rules.SEARCH_POOL, 35)} AS k, 1.0::DOUBLE AS factor FROM asked
    UNION ALL SELECT query_id, 'e' || (i - 1), e, 8, 0.8 FROM (SELECT query_id, unnest(en[1:5]) AS e, generate_subscripts(en[1:5], 1) AS i FROM asked)),
  pw AS (SELECT *, unnest(w) AS word FROM (SELECT query_id, part, k, factor, {_CONTENT("text")} AS w FROM parts)), lw AS (SELECT doc_id, pos, len(w) AS n, unnest(w) AS word FROM (SELECT doc_id, pos, {_CONTENT("text")} AS w FROM lines)),
  near AS (SELECT query_id, part, k, factor, doc_id, pos, round(count(*) / sqrt(len(any_value(w)) * any_value(n)), 9) AS cosine FROM pw JOIN lw USING (word) GROUP BY query_id, part, k, factor, doc_id, pos),
  top AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY query_id, part ORDER BY cosine DESC, doc_id, pos) <= k)"""


@query(f"""WITH {sql.LINES}{TYPED}, {_VECTOR}, b AS (SELECT query_id, doc_id, pos, factor / (2 - cosine) + CASE WHEN intent = 'summarization' AND page <= 2 THEN 0.25 ELSE 0 END + density / 10000.0::DOUBLE * 0.04 + {_BOOST} AS s
  FROM top JOIN typed USING (doc_id, pos) JOIN asked USING (query_id))
SELECT query_id, doc_id, pos, floor(max(s) * 1000000 + 0.5)::BIGINT AS score FROM b GROUP BY ALL""")
def vector_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are similar to questions and their entities, with the boosts of their types."""
    bench = _bench(spark, sf_dir)
    parts = retrieval.search_parts(bench).where("part = 'c0' OR part LIKE 'e%'")
    lines = views.dealt_lines(table(spark, sf_dir, "documents"))
    found = written(retrieval.vector_hits(parts, lines), "hits")
    typed = typed_of(lines.join(found.select("doc_id", "pos").distinct(), ["doc_id", "pos"], "left_semi"))  # only what was hit
    hits = retrieval.merge_best([retrieval.boosted(found, bench, typed)])
    return hits.select("query_id", "doc_id", "pos", F.floor(F.col("score") * 1000000 + 0.5).cast("long").alias("score"))


_CLAIMS = sql.claims(rules.CLAIM_PATTERNS)
_ORDER_QUESTIONS = ["Which orders mean a purchase with priority 1-URGENT?", "Order Discount within 30 days", "who"]
_DIGEST = f"""f AS (SELECT doc_id, section, value, claim_no, row_number() OVER (PARTITION BY doc_id, section ORDER BY claim_no) AS r FROM claims),
  dw AS (SELECT doc_id, section, list_distinct(string_split_regex(lower(string_agg(value, '; ' ORDER BY claim_no)), '\\s+')) AS dw FROM f WHERE r <= 20 GROUP BY ALL),
  qs AS (SELECT i - 1 AS query_id, text FROM (SELECT unnest({sql.listed(_ORDER_QUESTIONS)}) AS text, generate_subscripts({sql.listed(_ORDER_QUESTIONS)}, 1) AS i)),
  qw AS (SELECT query_id, list_distinct(list_transform({_ENTITIES}, lambda e: lower(e))) AS en, list_distinct(list_concat(string_split_regex(lower(text), '\\s+'), list_transform({_ENTITIES}, lambda e: lower(e)))) AS w FROM qs),
  ov AS (SELECT query_id, doc_id, section, len(list_intersect(w, dw)) AS o, len(list_intersect(en, dw)) AS e FROM qw, dw)"""


def _order_questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_ORDER_QUESTIONS)), "query_id long, text string")


@query(f"""WITH {_CLAIMS}, {_DIGEST} SELECT query_id, doc_id, pos, max(least(70, 12 * o + 15 * e))::BIGINT AS score100 FROM ov JOIN (SELECT DISTINCT doc_id, section, pos FROM claims) USING (doc_id, section)
WHERE o >= 2 OR e >= 1 GROUP BY ALL""")
def evidence_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of claims in sections whose digest speaks of what questions ask."""
    found = written(claims.extract(views.fact_lines(spark, sf_dir)), "claims")
    hits = retrieval.evidence_summary_hits(claims.section_evidence(found), found, _order_questions(spark))
    return hits.select("query_id", "doc_id", "pos", F.round(F.col("score") * 100).cast("long").alias("score100"))


@query(f"""WITH {_CLAIMS}, h AS (SELECT DISTINCT doc_id, pos, (pos % 9 + 1) / 10.0::DOUBLE AS score FROM claims WHERE claim_type = 'fact_specification'),
  e AS (SELECT a.doc_id, a.claim_no AS x, b.claim_no AS y FROM claims a JOIN claims b ON a.doc_id = b.doc_id AND a.section = b.section AND a.claim_no < b.claim_no AND a.pos = b.pos
    UNION ALL SELECT a.doc_id, a.claim_no, b.claim_no FROM claims a JOIN claims b ON a.doc_id = b.doc_id AND a.claim_no < b.claim_no AND length(a.value) > 4 AND contains(b.value, a.value))
SELECT 0::BIGINT AS query_id, h.doc_id, t.pos, floor(max(h.score) * 0.65 * 10000 + 0.5)::BIGINT AS score FROM h JOIN claims f ON f.doc_id = h.doc_id AND f.pos = h.pos JOIN e ON e.doc_id = f.doc_id AND e.x = f.claim_no
JOIN claims t ON t.doc_id = e.doc_id AND t.claim_no = e.y GROUP BY ALL""")
def claim_backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of claims that candidates' claims support or are linked to; lines of priorities play the candidates."""
    packed = written(claims.packed(claims.extract(views.fact_lines(spark, sf_dir))), "packed")
    found = packed.select("doc_id", F.inline("claims"))
    hits = found.where("claim_type = 'fact_specification'").select(F.lit(0).cast("long").alias("query_id"), "doc_id", "pos", ((F.col("pos") % 9 + 1) / 10).alias("score")).distinct()
    return retrieval.along_links(hits, claims.packed_links(packed)).select("query_id", "doc_id", "pos", F.floor(F.col("score") * 10000 + 0.5).cast("long").alias("score"))


_STOPS = sql.listed(sorted(set(rules.RECALL_STOP)))
_CONCEPTS = f"""pieces AS (SELECT doc_id, section, list_transform(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]'), lambda w: CASE WHEN regexp_matches(w, '^[\\p{{L}}_]') AND length(w) > 2 AND NOT list_contains({_STOPS}, w) THEN w ELSE '|' END) AS p FROM sectioned),
  phrased AS (SELECT doc_id, section, trim(unnest(string_split(array_to_string(p, ' '), '|'))) AS concept FROM pieces),
  counted AS (SELECT doc_id, section, concept, string_split(concept, ' ') AS w, count(*) AS n FROM phrased WHERE concept <> '' AND len(string_split(concept, ' ')) <= 3 GROUP BY ALL),
  spread AS (SELECT doc_id, section, concept, n, len(w) AS size, unnest(w) AS word FROM counted), weights AS (SELECT doc_id, section, word, sum(n * size) / sum(n) AS weight FROM spread GROUP BY ALL),
  scored AS (SELECT doc_id, section, concept, n, floor(sum(weight) * 1000 + 0.5 + 1e-6)::BIGINT AS weight FROM spread JOIN weights USING (doc_id, section, word) GROUP BY ALL),
  concepts AS (SELECT doc_id, section, concept, weight, row_number() OVER (PARTITION BY doc_id, section ORDER BY weight DESC, n DESC, concept)::INTEGER AS rank FROM scored QUALIFY rank <= 10)"""


@query(f"WITH {sql.SECTIONED}, {_CONCEPTS} SELECT doc_id, section, concept, rank, weight FROM concepts")
def section_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key concepts of every section, by the words that occur in its phrases."""
    return concepts.section_concepts(_lines(spark, sf_dir))


@query(f"""WITH {sql.SECTIONED}, {_CONCEPTS}, q AS (SELECT item_id AS query_id, text, list_distinct(list_transform({_ENTITIES}, lambda e: lower(e))) AS en FROM benchmark),
  e AS (SELECT query_id, unnest(en) AS entity FROM q), s AS (SELECT * FROM (SELECT query_id, unnest(list_distinct({sql.words("lower(text)")})) AS word FROM q WHERE len(en) > 0) WHERE length(word) > 3),
  names AS (SELECT DISTINCT concept FROM concepts), ec AS (SELECT entity, concept FROM (SELECT DISTINCT entity FROM e), names WHERE contains(concept, entity) OR contains(entity, concept)),
  wc AS (SELECT word, concept FROM (SELECT DISTINCT word FROM s), names WHERE contains(concept, word)),
  h AS (SELECT query_id, doc_id, section, 2 AS halves FROM e JOIN ec USING (entity) JOIN concepts USING (concept)
    UNION ALL SELECT DISTINCT ON (query_id, doc_id, section, word) query_id, doc_id, section, 1 FROM s JOIN wc USING (word) JOIN concepts USING (concept)),
  f AS (SELECT query_id, doc_id, section, sum(halves) AS halves FROM h GROUP BY ALL HAVING sum(halves) >= 2)
SELECT query_id, doc_id, pos, floor(least(0.55, halves * 0.075) * 1000 + 0.5)::BIGINT AS score FROM f JOIN sectioned USING (doc_id, section)""")
def concept_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the sections whose concepts fit benchmark questions."""
    lines = _lines(spark, sf_dir)
    hits = concepts.concept_hits(written(concepts.section_concepts(lines), "concepts"), _bench(spark, sf_dir), lines)
    return hits.select("query_id", "doc_id", "pos", F.floor(F.col("score") * 1000 + 0.5).cast("long").alias("score"))


def _every_source(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Benchmark questions, typed and sectioned lines, and the candidates of all sources with their best scores. Search walks
    along the edges of all kinds of one property graph."""
    bench = _bench(spark, sf_dir)
    typed = written(views.sectioned(typed_lines(spark, sf_dir)).withColumn("confidence", (F.lit(6) + F.col("pos") % 5) / 10).drop("look"), "typed")
    plain = typed.select("doc_id", "pos", "page", "section", "text", "confidence")
    found = written(claims.extract(plain), "claims")
    members = written(graph.theme_members(plain, graph.heuristic_themes(plain)), "members")
    links = vectors.semantic_links(letter_vectors(typed).select("doc_id", "pos", "section", "density", "v"))
    continued = layout.continuity(plain).select("doc_id", F.concat(F.lit("line:"), "pos").alias("src"), F.concat(F.lit("line:"), "next_pos").alias("dst"), F.lit("CONTINUES_ON_PAGE").alias("relationship"))
    edges = written(graphs.property_graph(plain, found, links, members, [continued]), "graph")
    near = retrieval.boosted(retrieval.vector_hits(retrieval.search_parts(bench), plain), bench, typed)
    chained = retrieval.expand_edges(near, graphs.line_edges(edges))
    intents = bench.select("query_id", F.explode(questions.metadata_intents(F.col("text"))).alias("kind"))
    noted = retrieval.evidence_summary_hits(claims.section_evidence(found), found, bench)
    themes = {name: " ".join([name, *terms]) for name, (_, terms) in rules.THEMES.items()}
    counted = written(retrieval.keyword_counts(bench, plain), "recalled")
    named = concepts.concept_hits(written(concepts.section_concepts(plain), "concepts"), bench, plain)
    sources = [chained, counted.drop("exact"), retrieval.metadata_scan(intents, typed_lines(spark, sf_dir)), retrieval.theme_hits(graphs.theme_edges(edges), themes, bench), named, noted]
    united = written(retrieval.merge_best(sources), "united")
    linked = retrieval.claim_backlinks(united, found, claims.supports(found).where("relationship = 'SUPPORTS'").unionByName(claims.linked(found)))
    every = retrieval.merge_best([united, linked]).join(counted.drop("score"), ["query_id", "doc_id", "pos"], "left").withColumn("exact", F.coalesce("exact", F.lit(1 << 20)))
    return bench, plain, ranking.most_match(every, bench)


@query()
def evidence_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From question to cited passages: candidates of all sources, consolidation, near repeats out, the re-ranking cascade
    (without a model the order stays), passages with their confidence."""
    bench, lines, candidates = _every_source(spark, sf_dir)
    asked = bench.select("query_id", F.col("text").alias("question"), questions.intent(F.col("text")).alias("intent"))
    pool = ranking.best_unlike(candidates, asked, lines, 40)
    cited = retrieval.citation_confidence(F.col("alignment_score"), F.col("confidence"), F.col("cross_encoder_score"), F.col("rank") <= 3)
    chosen = retrieval.cascade(pool.drop("rank"), seams.no_score(F.lit(""), F.lit("")))
    return retrieval.with_context(chosen, lines).select("query_id", "rank", "doc_id", "pos", "context", cited.alias("citation_confidence"))


@query("""WITH e AS (SELECT event_id, (event_id % 101) / 100.0::DOUBLE AS a, (event_id % 7) / 7.0::DOUBLE AS o, CASE WHEN event_id % 3 > 0 THEN (event_id % 21 - 10)::DOUBLE END AS c, event_id % 2 = 0 AS k FROM events)
SELECT event_id, floor(least(1.0, 0.40 * a + 0.30 * o + 0.20 * least(1.0, CASE WHEN c IS NULL THEN 0.5 ELSE greatest((c + 5) / 10, 0.0) END) + 0.10 + CASE WHEN k THEN 0.10 ELSE 0.0 END) * 1000 + 0.5 + 1e-9)::BIGINT AS confidence FROM e""")
def citation_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation confidences over made-up scores."""
    e = F.col("event_id")
    ce = F.when(e % 3 > 0, (e % 21 - 10).cast("double"))
    value = retrieval.citation_confidence((e % 101) / 100, (e % 7) / 7, ce, e % 2 == 0)
    return table(spark, sf_dir, "events").select("event_id", value.alias("confidence"))


@query("""SELECT user_id AS query_id, count(*)::BIGINT AS n_hits, floor(avg((event_id % 1000)::DOUBLE / 1000) * 1000 + 0.5)::BIGINT AS avg_score, floor(max((event_id % 1000)::DOUBLE / 1000) * 1000 + 0.5)::BIGINT AS max_score,
  count(DISTINCT event_type)::BIGINT AS n_sections FROM events GROUP BY user_id""")
def retrieval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of hits; events play them, in the order of their ids, in which the table holds them."""
    hits = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("query_id"), F.lit(0).alias("doc_id"), F.col("event_type").alias("section"), ((F.col("event_id") % 1000) / 1000).alias("alignment_score"))
    return retrieval.retrieval_stats(hits, "event_id")


_CROSS = [(i, a) for i in rules.INTENT_BOOSTS for a in [*rules.ANSWER_BOOSTS, "description"]]
_BOOST_CASES = " ".join(
    f"WHEN intent = '{i}' AND answer_type = '{a}' AND information_type = '{t}' THEN {round(rules.INTENT_BOOSTS[i].get(t, 0) * 100) + round(rules.ANSWER_BOOSTS.get(a, {}).get(t, 0) * 100)}"
    for i, a in _CROSS for t in rules.DENSITY_WEIGHTS
)


@query(f"""WITH {sql.LINES}{TYPED}, n AS (SELECT information_type, count(*)::BIGINT AS n_lines FROM typed WHERE information_type IS NOT NULL GROUP BY ALL),
  c AS (SELECT * FROM (VALUES {", ".join(f"('{i}', '{a}')" for i, a in _CROSS)}) v(intent, answer_type))
SELECT intent, answer_type, information_type, n_lines, (CASE {_BOOST_CASES} ELSE 0 END)::BIGINT AS boost FROM n, c""")
def type_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lines of each type get for all intents and answer types, and how many such lines there are."""
    kinds = F.array(*[F.struct(F.lit(i).alias("intent"), F.lit(a).alias("answer_type")) for i, a in _CROSS])
    counted = typed_lines(spark, sf_dir).where("information_type IS NOT NULL").groupBy("information_type").agg(F.count(F.lit(1)).alias("n_lines"))
    every = counted.select("information_type", "n_lines", F.explode(kinds).alias("k")).select("k.intent", "k.answer_type", "information_type", "n_lines")
    boost = retrieval.type_boost(F.col("intent"), F.col("answer_type"), F.col("information_type"))
    return every.select("*", F.round(boost * 100).cast("long").alias("boost"))
