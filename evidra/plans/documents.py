"""Queries on documents, pages and vectors: ingest, page types, line types, vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.functions import rules
from evidra.functions.text import strip
from evidra.operators import classify, tables, vectors
from evidra.plans import sql
from evidra.plans.catalog import query
from evidra.sources import views
from evidra.sources.views import table

_TYPE_SQL = f"""CASE WHEN {sql.strip("text")} = '' THEN NULL ELSE {sql.rule_chain(f"lower({sql.strip('text')})", rules.INFORMATION_TYPES, f'''
  CASE WHEN regexp_matches({sql.strip("text")}, {sql.text(rules.EMAIL)}) THEN 'metadata'
       WHEN page <= 2 AND len({sql.words(sql.strip("text"))}) <= 25 AND regexp_matches({sql.strip("text")}, {sql.text(rules.AFFILIATION)}) THEN 'metadata'
       WHEN page <= 2 AND regexp_matches({sql.strip("text")}, {sql.text(rules.PROPER_NAME)}) THEN 'metadata' ELSE 'fact' END''')} END"""
_WORDS = sql.words(sql.strip("text"))
_RAW = f"""(5000 + least(1200, 250 * len(list_filter(w[2:], lambda x: regexp_matches(x, '^\\p{{Lu}}'))))
  + least(1200, 400 * len(list_filter(w, lambda x: regexp_matches(x, '[0-9]')))) + least(800, 200 * len(list_filter(w, lambda x: length(x) >= 9)))
  + {sql.mapped("coalesce(information_type, 'fact')", {k: round(w * 10000) for k, w in rules.DENSITY_WEIGHTS.items()}, 0)})"""
TYPED = f""", typed AS (
  SELECT *, CASE WHEN {sql.strip("text")} = '' THEN 0 ELSE least(10000, greatest(0, CASE WHEN len(w) < 3 THEN floor({_RAW} * 3 / 10) ELSE {_RAW} END)) END::BIGINT AS density
  FROM (SELECT *, {_TYPE_SQL} AS information_type, {_WORDS} AS w FROM paged))"""


def typed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines with their information type and density."""
    return typed_of(views.dealt_lines(table(spark, sf_dir, "documents")))


def typed_of(lines: DataFrame) -> DataFrame:
    """Lines with their information type and density."""
    typed = classify.with_looks(lines).withColumn("information_type", classify.type_of(F.col("look"), F.col("page")))
    return typed.withColumn("density", classify.density_of(F.col("look"), F.col("information_type")))


@query("SELECT doc_id, sha256(text) AS checksum, octet_length(encode(text))::BIGINT AS n_bytes, floor(octet_length(encode(text)) / 1048576.0 * 100 + 0.5)::BIGINT AS mb100 FROM documents")
def sha256_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest and size of every document."""
    n = F.octet_length("text").cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"), n.alias("n_bytes"), F.floor(n / 1048576 * 100 + 0.5).cast("long").alias("mb100"))


@query("SELECT sha256(text) AS checksum, min(doc_id) AS doc_id, count(*)::BIGINT AS n_copies FROM documents GROUP BY ALL")
def catalog_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingested documents, those of equal content once."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("checksum")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"))


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 7")
def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document by its key; the filter reaches the scan."""
    return table(spark, sf_dir, "documents").where("doc_id = 7").select("doc_id", "lang", "source", "n_chars")


@query(f"WITH {sql.LINES} SELECT doc_id, pos, page, text FROM paged")
def line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines with position and page."""
    return views.lines(table(spark, sf_dir, "documents")).select("doc_id", "pos", "page", "text")


@query(f"WITH {sql.LINES} SELECT doc_id, count(*)::BIGINT AS n_lines, max(page) AS n_pages, sum(length(text))::BIGINT AS n_chars FROM paged GROUP BY doc_id")
def upload_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, pages and characters of each document."""
    return views.lines(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max("page").alias("n_pages"), F.sum(F.char_length("text")).cast("long").alias("n_chars"))


@query("""WITH p AS (SELECT page_id, length(trim(regexp_replace(html, '<[^>]*>', ' ', 'g'))) > 5 AS t, contains(lower(html), '<img') AS i FROM pages)
SELECT page_id, CASE WHEN t AND i THEN 'mixed' WHEN i THEN 'scanned' WHEN t THEN 'digital' ELSE 'scanned' END AS page_type FROM p""")
def page_type_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page types of web pages."""
    has_text = F.char_length(F.trim(F.regexp_replace("html", "<[^>]*>", " "))) > 5
    return table(spark, sf_dir, "pages").select("page_id", classify.page_type(has_text, F.contains(F.lower("html"), F.lit("<img")), F.lit(0.0)).alias("page_type"))


def _region_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    row = F.concat(F.lit("<tr><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td><b>"), F.col("n_name"), F.lit("</b></td></tr>"))
    rows = nations.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda x: x["r"]), "").alias("body"))
    html = F.concat(F.lit("<table><tr><th>key</th><th>nation</th></tr>"), F.col("body"), F.lit("</table>"))
    return regions.join(rows, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_regionkey").alias("table_id"), html.alias("html"))


_CELLS_SQL = """WITH body AS (
  SELECT n_regionkey AS table_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r, n_nationkey, n_name FROM nation
), cells AS (
  SELECT table_id, r::INTEGER AS "row", 0 AS col, n_nationkey::VARCHAR AS text FROM body UNION ALL SELECT table_id, r::INTEGER, 1, n_name FROM body
  UNION ALL SELECT DISTINCT table_id, 0, 0, 'key' FROM body UNION ALL SELECT DISTINCT table_id, 0, 1, 'nation' FROM body)"""


@query(_CELLS_SQL + """ SELECT table_id, "row", col, text, "row" = 0 AS is_header FROM cells""")
def html_table_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of HTML tables."""
    parsed = _region_tables(spark, sf_dir).select("table_id", tables.parse_html_table(F.col("html")).alias("rows"))
    return tables.cells_of(parsed)


@query(_CELLS_SQL + """ SELECT table_id, string_agg('R' || "row" || 'C' || col || ': ' || text, '; ' ORDER BY "row", col) AS text FROM cells GROUP BY table_id""")
def table_embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of each table as it is embedded."""
    return tables.table_text(html_table_parse(spark, sf_dir))


@query(f"""WITH t AS (SELECT p_type AS table_id, string_agg(p_name, ' ' ORDER BY p_partkey) AS cells FROM part GROUP BY p_type)
SELECT table_id, {sql.rule_chain("lower(cells)", rules.TABLE_TYPES, "'data_table'")} AS table_type, {sql.rule_chain("lower(cells)", rules.IMAGE_TYPES, "'figure'")} AS image_type FROM t""")
def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of tables and images by their words."""
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]), " ")
    cells = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("table_id")).agg(names.alias("cells"))
    return cells.select("table_id", classify.table_type(F.col("cells")).alias("table_type"), classify.image_type(F.col("cells")).alias("image_type"))


@query(f"WITH {sql.LINES}{TYPED} SELECT doc_id, pos, information_type FROM typed")
def info_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Information type of every line."""
    return typed_lines(spark, sf_dir).select("doc_id", "pos", "information_type")


@query(f"WITH {sql.LINES}{TYPED} SELECT doc_id, pos, density FROM typed")
def semantic_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density of every line."""
    return typed_lines(spark, sf_dir).select("doc_id", "pos", "density")


def noise(s: str) -> str:
    """Whether a stripped line only structures its document."""
    return f"""(regexp_matches({s}, '\\.{{4,}}|-{{4,}}') OR regexp_matches({s}, '^[\\d\\.\\s\\-]+$') OR (regexp_matches({s}, '\\.\\s*\\d+\\s*$') AND contains({s}, '...'))
  OR (upper({s}) = {s} AND regexp_matches({s}, '\\p{{L}}') AND NOT regexp_matches({s}, '[0-9]') AND len({sql.words(s)}) <= 3))"""


@query(f"WITH {sql.LINES}, s AS (SELECT doc_id, pos, {sql.strip('text')} AS s FROM lines) SELECT doc_id, pos FROM s WHERE {noise('s')}")
def structural_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that only structure a document."""
    return views.lines(table(spark, sf_dir, "documents")).where(classify.is_structural_noise(F.col("text"))).select("doc_id", "pos")


@query("""WITH v AS (SELECT vec_id, embedding FROM embeddings), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, round(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 9) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s QUALIFY rank <= 8""")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight nearest vectors by inner product to every fiftieth vector."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return vectors.nearest(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), v, 8).select("query_id", "vec_id", "rank")


@query("""WITH v AS (SELECT vec_id, embedding FROM embeddings), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, round(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 9) AS d
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id)::INTEGER AS rank FROM s QUALIFY rank <= 5""")
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors by distance to every fiftieth vector."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return vectors.nearest(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), v, 5, "l2").select("query_id", "vec_id", "rank")


_LETTERS = "etaonisrhldcumpfgwybvkxjqz"
_UNIT = f"[{', '.join(f"length(text) - length(replace(low, '{c}', ''))" for c in _LETTERS)}]::DOUBLE[]"


def letter_vectors(lines: DataFrame) -> DataFrame:
    """Lines with their letters' numbers as vectors v, which stand in for a model's."""
    low = F.lower("text")
    return lines.withColumn("v", F.array(*[(F.char_length("text") - F.char_length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in _LETTERS]))


@query(f"""WITH {sql.SECTIONED}{TYPED.replace("FROM paged", "FROM sectioned")}, v AS (SELECT doc_id, pos, section, density, {_UNIT} AS v FROM (SELECT *, lower(text) AS low FROM typed)),
  u AS (SELECT *, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS n FROM v), f AS (SELECT * FROM u WHERE density >= 6500 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 15),
  s AS (SELECT f.doc_id, f.pos AS query_pos, f.section AS qs, u.pos, u.section, round(greatest(0, 1 - list_dot_product(f.v, u.v) / (f.n * u.n)), 9) AS d FROM f JOIN u ON f.doc_id = u.doc_id),
  r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, query_pos ORDER BY d, pos) <= 3)
SELECT doc_id, query_pos, pos, round(1 - d, 4) AS similarity FROM r WHERE d < 0.35 AND qs <> section AND pos <> query_pos""")
def semantic_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from the first dense lines of each document to near lines of its other sections."""
    return vectors.semantic_links(letter_vectors(views.sectioned(typed_lines(spark, sf_dir))).select("doc_id", "pos", "section", "density", "v"))


@query(f"""WITH {sql.LINES}, t AS (SELECT doc_id, pos, text, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM lines WHERE {sql.strip("text")} <> '')
SELECT doc_id, string_agg(text, chr(10) ORDER BY pos) AS sample FROM t WHERE r <= 15 GROUP BY doc_id""")
def suggestion_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifteen lines of each document, from which questions are suggested."""
    lines = views.lines(table(spark, sf_dir, "documents")).where(strip(F.col("text")) != "")
    first = lines.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).where("r <= 15")
    return first.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("sample"))
