"""Queries on claims: extraction, relations, summaries. They run on sentences rendered from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import rules
from evidra.operators import claims, graph
from evidra.operators import property_graph as graphs
from evidra.plans import sql
from evidra.plans.catalog import query
from evidra.plans.layouts import EDGES
from evidra.sources import views
from evidra.sources.scratch import written

_C = sql.claims(rules.CLAIM_PATTERNS)


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.extract(views.fact_lines(spark, sf_dir))


def _kept_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that are read more than once, extracted once."""
    return written(_claims(spark, sf_dir), "claims")


def _packed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims whose documents are rows, extracted once."""
    return written(claims.packed(_claims(spark, sf_dir)), "packed")


@query(f"WITH {_C} SELECT doc_id, section, pos, claim_type, value, claim_no FROM claims")
def extract_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All claims with their numbers."""
    return _claims(spark, sf_dir).select("doc_id", "section", "pos", "claim_type", "value", F.col("claim_no").cast("long").alias("claim_no"))


def _of_kind(kind: str):
    def of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _claims(spark, sf_dir).where(F.col("claim_type") == kind).select("doc_id", "pos", "value")

    return of_kind


for _name, _kind in {
    "claims_date": "entity_date", "claims_money": "entity_money", "claims_percent": "entity_statistic", "claims_duration": "entity_duration",
    "claims_definition": "fact_definition", "claims_kv": "fact_specification", "claims_email": "entity_contact",
}.items():
    _function = _of_kind(_kind)
    _function.__name__, _function.__doc__ = _name, f"Claims of kind {_kind}."
    query(f"WITH {_C} SELECT doc_id, pos, value FROM claims WHERE claim_type = '{_kind}'")(_function)

_PAIR = "FROM claims a JOIN claims b ON a.doc_id = b.doc_id AND a.claim_no < b.claim_no"


@query(f"""WITH {_C} SELECT a.doc_id, a.claim_no AS a_claim_no, b.claim_no AS b_claim_no, CASE WHEN a.pos = b.pos THEN 'SUPPORTS' ELSE 'RELATED_TO' END AS relationship
{_PAIR} AND a.section = b.section""")
def claim_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that support each other or are related."""
    return claims.supports(_kept_claims(spark, sf_dir)).select("doc_id", F.col("a_claim_no").cast("long").alias("a_claim_no"), F.col("b_claim_no").cast("long").alias("b_claim_no"), "relationship")


@query(f"""WITH {_C}, c2 AS (SELECT *, section // 8 AS s8 FROM claims) SELECT a.doc_id, a.claim_no AS a_claim_no, b.claim_no AS b_claim_no, 'CONTRADICTS' AS relationship
FROM c2 a JOIN c2 b ON a.doc_id = b.doc_id AND a.claim_no < b.claim_no AND a.s8 = b.s8 AND a.claim_type = b.claim_type AND a.value <> b.value
WHERE a.claim_type IN ('entity_date', 'entity_money', 'entity_statistic')""")
def claim_contradicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of one kind that tell different values, in sections of eight neighbouring orders."""
    wide = _kept_claims(spark, sf_dir).withColumn("section", F.expr("section div 8"))
    return claims.contradictions(wide).select("doc_id", F.col("a_claim_no").cast("long").alias("a_claim_no"), F.col("b_claim_no").cast("long").alias("b_claim_no"), "relationship")


@query(f"""WITH {_C} SELECT a.doc_id, a.claim_no AS a_claim_no, b.claim_no AS b_claim_no, 'LINKED_TO' AS relationship
{_PAIR} AND length(a.value) > 4 AND contains(b.value, a.value)""")
def claim_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims whose value another one holds."""
    return claims.packed_linked(_packed_claims(spark, sf_dir)).select("doc_id", F.col("a_claim_no").cast("long").alias("a_claim_no"), F.col("b_claim_no").cast("long").alias("b_claim_no"), "relationship")


@query(f"""WITH {_C}, t AS (SELECT doc_id, max(claim_no) AS definition_no, lower(trim(string_split(value, '=')[1])) AS term FROM claims WHERE claim_type = 'fact_definition' GROUP BY ALL)
SELECT DISTINCT c.doc_id, c.claim_no, t.definition_no FROM claims c JOIN t ON c.doc_id = t.doc_id WHERE term <> '' AND c.claim_no <> t.definition_no AND contains(lower(c.value), term)""")
def claim_depends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that use a term which another one defines."""
    return claims.packed_depends(_packed_claims(spark, sf_dir)).select("doc_id", F.col("claim_no").cast("long").alias("claim_no"), F.col("definition_no").cast("long").alias("definition_no"))


@query(f"""WITH {_C}, e AS (
  SELECT a.doc_id, a.claim_no AS x, b.claim_no AS y, CASE WHEN a.pos = b.pos THEN 'SUPPORTS' ELSE 'RELATED_TO' END AS r, 0 AS w {_PAIR} AND a.section = b.section
  UNION ALL SELECT a.doc_id, a.claim_no, b.claim_no, 'LINKED_TO', 1 {_PAIR} AND length(a.value) > 4 AND contains(b.value, a.value)
  UNION ALL SELECT a.doc_id, a.claim_no, b.claim_no, 'CONTRADICTS', 2 {_PAIR} AND a.section = b.section AND a.claim_type = b.claim_type AND a.value <> b.value AND a.claim_type IN ('entity_date', 'entity_money', 'entity_statistic'))
SELECT doc_id, x AS a_claim_no, y AS b_claim_no, arg_max(r, w) AS relationship FROM e GROUP BY ALL""")
def claim_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One relationship for each pair of claims: that written last."""
    return claims.packed_edges(_packed_claims(spark, sf_dir)).select("doc_id", F.col("a_claim_no").cast("long").alias("a_claim_no"), F.col("b_claim_no").cast("long").alias("b_claim_no"), "relationship")


@query(f"""WITH {_C}, k AS (SELECT doc_id, section, claim_type, count(*) AS n FROM claims GROUP BY ALL),
  h AS (SELECT doc_id, section, sum(n)::BIGINT AS claim_count, string_agg(claim_type || '=' || n, '|' ORDER BY claim_type || '=' || n) AS claim_types FROM k GROUP BY ALL),
  f AS (SELECT doc_id, section, value, claim_no, row_number() OVER (PARTITION BY doc_id, section ORDER BY claim_no) AS r FROM claims)
SELECT h.doc_id, h.section, claim_count, claim_types, string_agg(value, '; ' ORDER BY claim_no) AS facts_digest FROM h JOIN f USING (doc_id, section) WHERE r <= 20 GROUP BY ALL""")
def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of every section."""
    return claims.section_evidence(_claims(spark, sf_dir))


_W = r"[\p{L}\p{N}_\s]"
_TERM = rf"""(?i)^["']?({_W}{{2,30}}?)["']?\s+(?:is\s+(?:defined|a|an|the)|refers?\s+to|known\s+as)"""


def _graph_sql(lines: str) -> str:
    """The whole graph of lines (CTEs that end with ``sectioned``) and claims: kinds are written in turn, and uses of
    definitions give way to all others."""
    found = sql.claims(rules.CLAIM_PATTERNS, f"{lines}{EDGES}, facts AS (SELECT doc_id, section, pos, text FROM sectioned)")
    return f"""{found}, dl AS (SELECT doc_id, pos, lower(trim(regexp_extract(text, {sql.text(_TERM)}, 1))) AS term FROM sectioned WHERE regexp_matches(text, {sql.text(rules.DEFINITION_GATE)}) AND regexp_matches(text, {sql.text(_TERM)})),
  dt AS (SELECT doc_id, term, max(pos) AS def_pos FROM dl WHERE length(term) > 2 GROUP BY ALL), du AS (SELECT DISTINCT n.doc_id, t.def_pos, n.pos FROM sectioned n JOIN dt t ON n.doc_id = t.doc_id AND n.pos <> t.def_pos AND contains(lower(n.text), t.term)),
  bw AS (SELECT DISTINCT doc_id, section, word FROM (SELECT doc_id, section, unnest({sql.words("lower(text)")}) AS word FROM sectioned) WHERE length(word) >= 5), bz AS (SELECT doc_id, section, count(*) AS n FROM bw GROUP BY ALL),
  bc AS (SELECT a.doc_id, a.section AS s1, b.section AS s2, count(*) AS common FROM bw a JOIN bw b USING (doc_id, word) WHERE a.section < b.section GROUP BY ALL HAVING count(*) >= 3),
  bf AS (SELECT c.* FROM bc c JOIN bz x ON x.doc_id = c.doc_id AND x.section = s1 JOIN bz y ON y.doc_id = c.doc_id AND y.section = s2 WHERE common / least(x.n, y.n) > 0.05),
  cd AS (SELECT doc_id, max(claim_no) AS definition_no, lower(trim(string_split(value, '=')[1])) AS term FROM claims WHERE claim_type = 'fact_definition' GROUP BY ALL),
  every AS (SELECT doc_id, src, dst, relationship, write_seq AS w FROM edges
    UNION ALL SELECT doc_id, 'sec:' || s1, 'sec:' || s2, 'TOPIC_BRIDGE', 5 FROM bf UNION ALL SELECT doc_id, 'sec:' || s2, 'sec:' || s1, 'TOPIC_BRIDGE', 5 FROM bf
    UNION ALL SELECT doc_id, 'line:' || def_pos, 'line:' || pos, 'DEFINITION_USED_IN', -1 FROM du
    UNION ALL SELECT doc_id, 'claim:' || claim_no, 'line:' || pos, 'SUPPORTED_BY', 7 FROM claims
    UNION ALL SELECT c.doc_id, 'claim:' || c.claim_no, 'claim:' || definition_no, 'DEPENDS_ON', 8 FROM claims c JOIN cd ON c.doc_id = cd.doc_id WHERE term <> '' AND claim_no <> definition_no AND contains(lower(value), term)
    UNION ALL SELECT a.doc_id, 'claim:' || a.claim_no, 'claim:' || b.claim_no, CASE WHEN a.pos = b.pos THEN 'SUPPORTS' ELSE 'RELATED_TO' END, 9 {_PAIR} AND a.section = b.section
    UNION ALL SELECT a.doc_id, 'claim:' || a.claim_no, 'claim:' || b.claim_no, 'LINKED_TO', 10 {_PAIR} AND length(a.value) > 4 AND contains(b.value, a.value)
    UNION ALL SELECT a.doc_id, 'claim:' || a.claim_no, 'claim:' || b.claim_no, 'CONTRADICTS', 11 {_PAIR} AND a.section = b.section AND a.claim_type = b.claim_type AND a.value <> b.value AND a.claim_type IN ('entity_date', 'entity_money', 'entity_statistic')
    UNION ALL SELECT DISTINCT doc_id, 'summary:' || section, 'sec:' || section, 'SUMMARISES_EVIDENCE_FOR', 12 FROM claims
    UNION ALL SELECT doc_id, 'summary:' || section, 'claim:' || claim_no, 'AGGREGATES', 13 FROM claims),
  g AS MATERIALIZED (SELECT doc_id, src, dst, arg_max(relationship, w) AS relationship FROM every GROUP BY ALL)"""


@query(f"WITH {_graph_sql(sql.SECTIONED)} SELECT doc_id, src, dst, relationship FROM g")
def property_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of documents: structure, bridges, definitions, claims and summaries, one edge for each pair of nodes."""
    lines = views.sectioned(views.dealt_lines(views.table(spark, sf_dir, "documents"))).select("doc_id", "pos", "section", "text")
    found = written(claims.extract(lines), "claims")
    return graphs.property_graph(lines, found, chains=False).select("doc_id", "src", "dst", "relationship")


#: Shortest paths by joining what two ends see from two edges away, without hubs.
@query(f"""WITH {_graph_sql(f"{sql.REPORTS}, sectioned AS (SELECT * FROM reports)")}, near AS MATERIALIZED (SELECT doc_id, src AS u, dst AS v FROM g WHERE src <> dst UNION SELECT doc_id, dst, src FROM g WHERE src <> dst),
  b AS (SELECT DISTINCT doc_id, section, pos FROM claims), i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM b),
  pairs AS MATERIALIZED (SELECT x.doc_id, x.pos AS p1, y.pos AS p2, 'line:' || x.pos AS a, 'line:' || y.pos AS b FROM i x JOIN i y ON x.doc_id = y.doc_id AND y.n BETWEEN x.n + 1 AND x.n + 39 WHERE x.section <> y.section),
  ends AS (SELECT doc_id, a AS e FROM pairs UNION SELECT doc_id, b FROM pairs), one AS (SELECT n.doc_id, e, v AS u FROM ends JOIN near n ON n.doc_id = ends.doc_id AND n.u = e),
  two AS (SELECT o.doc_id, e, v AS u, min(o.u) AS x FROM one o JOIN near n ON n.doc_id = o.doc_id AND n.u = o.u WHERE v <> e AND NOT EXISTS (FROM one z WHERE z.doc_id = o.doc_id AND z.e = o.e AND z.u = n.v) GROUP BY ALL),
  ball AS MATERIALIZED (SELECT doc_id, e, e AS u, 0 AS d, []::VARCHAR[] AS way FROM ends UNION ALL SELECT doc_id, e, u, 1, [] FROM one UNION ALL SELECT doc_id, e, u, 2, [x] FROM two),
  met AS (SELECT p.doc_id, p1, p2, s.d + t.d AS steps, list_concat(s.way, CASE WHEN s.u IN (a, b) THEN [] ELSE [s.u] END, t.way) AS via
    FROM pairs p JOIN ball s ON s.doc_id = p.doc_id AND s.e = a JOIN ball t ON t.doc_id = p.doc_id AND t.e = b AND t.u = s.u),
  best AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY doc_id, p1, p2 ORDER BY steps, via) = 1)
SELECT doc_id, p1, p2, (steps + 1)::INTEGER AS chain_length, array_to_string(via, '|') AS via FROM best WHERE steps BETWEEN 2 AND 4""")
def evidence_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains between claim-bearing lines of different sections, along the whole graph of reports on orders."""
    lines = views.report_lines(spark, sf_dir)
    found = views.dealt(written(claims.extract(lines), "claims"))
    chains = claims.evidence_chains(found, graphs.property_graph(lines, found, chains=False))
    return chains.select("doc_id", "p1", "p2", "chain_length", F.array_join("via", "|").alias("via"))


_DEFS = f"""WITH n AS (SELECT p_size AS doc_id, p_partkey AS pos, p_name || ' is a ' || p_type || ' of brand ' || p_brand AS text FROM part),
  d AS (SELECT doc_id, pos, lower(trim(regexp_extract(text, {sql.text(_TERM)}, 1))) AS term FROM n WHERE regexp_matches(text, {sql.text(rules.DEFINITION_GATE)}) AND regexp_matches(text, {sql.text(_TERM)})),
  t AS (SELECT doc_id, term, max(pos) AS def_pos, min(pos) AS first_pos FROM d WHERE length(term) > 2 GROUP BY ALL)"""


def _part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("p_name"), F.lit(" is a "), F.col("p_type"), F.lit(" of brand "), F.col("p_brand"))
    return views.table(spark, sf_dir, "part").select(F.col("p_size").alias("doc_id"), F.col("p_partkey").alias("pos"), text.alias("text"))


@query(_DEFS + " SELECT doc_id, term, def_pos, first_pos FROM t")
def definition_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that part descriptions define; a document per part size."""
    return graph.definition_terms(_part_lines(spark, sf_dir))


@query(_DEFS + """, u AS (SELECT n.doc_id, t.def_pos, n.pos AS use_pos, t.term, row_number() OVER (PARTITION BY n.doc_id, t.def_pos, n.pos ORDER BY t.first_pos, t.term) AS r
  FROM n JOIN t ON n.doc_id = t.doc_id AND n.pos <> t.def_pos AND contains(lower(n.text), t.term))
SELECT doc_id, def_pos, use_pos, term FROM u WHERE r = 1""")
def definition_used_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that use a term another one defines."""
    return graph.definition_uses(_part_lines(spark, sf_dir))
