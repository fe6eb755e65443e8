"""Queries on what page readers report: spans, table cells, pages without blocks, and the edges of what is made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators import classify, graph, layout, scan
from evidra.plans import sql
from evidra.plans.catalog import query
from evidra.plans.layouts import _PARAGRAPHS
from evidra.sources import views
from evidra.sources.views import table

_FONTS = ["Serif", "Serif-Bold", "Sans-Oblique", "Sans-Black"]
_SPANS = f"""spans AS (SELECT doc_id, page, pos AS line_no, i - 1 AS span_no, w AS text, (9 + (i * 7 + pos) % 4)::DOUBLE AS size, {sql.listed(_FONTS)}[((i + pos) % 9) % 4 + 1] AS font
  FROM (SELECT doc_id, page, pos, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM paged))"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = views.lines(views.whole_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "page", F.col("pos").alias("line_no"), F.posexplode(F.split("text", " ", -1)).alias("span_no", "text"))
    i = F.col("span_no") + 1
    font = F.element_at(F.array(*map(F.lit, _FONTS)), ((i + F.col("line_no")) % 9 % 4 + 1).cast("int"))
    return words.withColumn("size", (9 + (i * 7 + F.col("line_no")) % 4).cast("double")).withColumn("font", font)


@query(f"""WITH {sql.LINES}, {_SPANS}, u AS (SELECT * FROM spans WHERE {sql.strip("text")} <> ''), c AS (SELECT doc_id, page, line_no, size, count(*) AS n FROM u GROUP BY ALL),
  m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, page, line_no ORDER BY n DESC, size DESC) = 1), p AS (SELECT doc_id, page, avg(size) AS a, max(size) AS t FROM u GROUP BY ALL),
  l AS (SELECT doc_id, page, line_no, string_agg(text, '' ORDER BY span_no) AS text, arg_min(font, span_no) AS font_name, bool_or(contains(lower(font), 'bold') OR contains(lower(font), 'black')) AS is_bold,
    bool_or(contains(lower(font), 'italic') OR contains(lower(font), 'oblique')) AS is_italic FROM u GROUP BY ALL)
SELECT doc_id, page, line_no, {sql.strip("l.text")} AS text, font_name, is_bold, is_italic, m.size AS font_size, floor(p.a * 1000 + 0.5)::BIGINT AS avg_font, p.t AS max_font,
  row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no)::INTEGER AS sequence FROM l JOIN m USING (doc_id, page, line_no) JOIN p USING (doc_id, page)""")
def digital_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines put together from spans; a document's words play them."""
    found = scan.digital_lines(_spans(spark, sf_dir))
    return found.withColumn("avg_font", F.floor(F.col("avg_font") * 1000 + 0.5).cast("long")).drop("confidence")


@query(f"""WITH {sql.LAYOUT}, f AS (SELECT doc_id, list_sort(list(font_size)) AS s FROM layout GROUP BY doc_id) SELECT doc_id, s[len(s) // 2 + 1] AS median_font, s[len(s)] AS max_font FROM f""")
def font_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median and largest font of every document."""
    return scan.font_statistics(views.layout(table(spark, sf_dir, "documents")))


@query(f"""WITH {sql.LINES}, b AS (SELECT DISTINCT doc_id, page FROM paged WHERE page % 2 = doc_id % 2) SELECT doc_id, page, pos, text, 'digital_fallback' AS source, 5::BIGINT AS confidence10
FROM paged p WHERE {sql.strip("text")} <> '' AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = p.doc_id AND b.page = p.page)""")
def fallback_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain lines of pages without blocks: every other page has none."""
    lines = views.lines(table(spark, sf_dir, "documents"))
    found = scan.fallback_lines(lines, lines.where("page % 2 = doc_id % 2"))
    return found.select("doc_id", "page", "pos", "text", "source", F.round(F.col("confidence") * 10).cast("long").alias("confidence10"))


_TABLES = """t AS (SELECT ps.page_id AS table_id, ps.page_id % 5 + 1 AS page, [string_split(url, '/'), [url, NULL], ['', ' ' || page_id || ' ']] AS rows FROM pages ps)"""


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(F.split("url", "/", -1), F.array(F.col("url"), F.lit(None).cast("string")), F.array(F.lit(""), F.concat(F.lit(" "), F.col("page_id").cast("string"), F.lit(" "))))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("table_id"), (F.col("page_id") % 5 + 1).alias("page"), rows.alias("rows"))


@query(f"""WITH {_TABLES}, r AS (SELECT *, len(rows) AS row_count, list_max(list_transform(rows, lambda x: len(x))) AS col_count, unnest(rows) AS cells, generate_subscripts(rows, 1) - 1 AS row FROM t),
  c AS (SELECT *, unnest(cells) AS cell, generate_subscripts(cells, 1) - 1 AS col FROM r)
SELECT table_id, page, row::INTEGER AS row, col::INTEGER AS col, row_count::INTEGER AS row_count, col_count::INTEGER AS col_count, {sql.strip("coalesce(cell, '')")} AS text, row = 0 AS is_header FROM c""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of tables; the parts of urls play them."""
    return scan.table_cells(_tables(spark, sf_dir)).drop("confidence")


@query(f"""WITH {sql.LINES}, k AS (SELECT doc_id, page, pos // 7 AS table_no, pos % 7 AS row, 0 AS col, text FROM paged WHERE pos % 7 < 2), b AS (SELECT doc_id, page, pos, text FROM paged WHERE pos % 7 >= 2),
  u AS (SELECT doc_id, page, doc_id || '_' || page || '_table_' || table_no || '_' || row || '_' || col AS line_id, text, 0 AS kind, table_no AS a, row AS b, col AS c FROM k WHERE {sql.strip("text")} <> ''
    UNION ALL SELECT doc_id, page, doc_id || '_' || page || '_' || pos, text, 1, pos, 0, 0 FROM b WHERE {sql.strip("text")} <> '')
SELECT doc_id, page, line_id, text, CASE kind WHEN 0 THEN 'table_cell' ELSE 'paragraph' END AS source, row_number() OVER (PARTITION BY doc_id ORDER BY page, kind, a, b, c)::INTEGER AS sequence FROM u""")
def normalised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and paragraph lines in one sequence; two of seven lines play cells."""
    lines = views.lines(table(spark, sf_dir, "documents"))
    cells = lines.where("pos % 7 < 2").select("doc_id", "page", F.expr("cast(pos div 7 as int)").alias("table_no"), (F.col("pos") % 7).alias("row"), F.lit(0).alias("col"), "text")
    return scan.normalised_lines(cells, lines.where("pos % 7 >= 2").select("doc_id", "page", "pos", "text"))


@query(f"""WITH {sql.LAYOUT}{_PARAGRAPHS}, sec AS (SELECT doc_id, pos, sum(CASE WHEN {sql.is_header("text")} OR pos % 10 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos)::INTEGER AS section FROM paged),
  j AS (SELECT p.doc_id, 'par:' || p.page || ':' || p.paragraph AS src, 'line:' || p.pos AS line, 'sec:' || section AS sec FROM paragraphs p JOIN sec USING (doc_id, pos))
SELECT doc_id, src, line AS dst, 'PARAGRAPH_CONTAINS' AS relationship FROM j UNION ALL SELECT DISTINCT doc_id, src, sec, unnest(['BELONGS_TO', 'PARAGRAPH_SUMMARY_OF']) FROM j""")
def paragraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from paragraphs to their lines and sections."""
    documents = table(spark, sf_dir, "documents")
    lines = layout.paragraphs(classify.with_elements(views.layout(documents))).select("doc_id", "page", "paragraph", "pos")
    return graph.paragraph_edges(lines.join(views.sectioned(views.lines(documents)).select("doc_id", "pos", "section"), ["doc_id", "pos"]))


@query(f"""WITH {sql.SECTIONED}, k AS (SELECT doc_id, pos // 7 AS t, pos % 7 AS row, 0 AS col, pos FROM sectioned WHERE pos % 7 BETWEEN 2 AND 4),
  f AS (SELECT k.doc_id, t, arg_min(section, row) AS section FROM k JOIN sectioned USING (doc_id, pos) GROUP BY ALL)
SELECT doc_id, 'line:' || pos AS src, 'table:' || t AS dst, 'TABLE_CELL_OF' AS relationship FROM k UNION ALL SELECT DISTINCT doc_id, 'doc:' || doc_id, 'table:' || t, 'BELONGS_TO' FROM k
UNION ALL SELECT doc_id, 'table:' || t, 'sec:' || section, 'TABLE_CONTEXT' FROM f""")
def table_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of tables; three of seven lines play cells."""
    lines = views.sectioned(views.lines(table(spark, sf_dir, "documents")))
    cells = lines.where("pos % 7 BETWEEN 2 AND 4").select("doc_id", F.expr("cast(pos div 7 as int)").alias("table_no"), (F.col("pos") % 7).alias("row"), F.lit(0).alias("col"), "pos")
    return graph.table_edges(cells, lines)
