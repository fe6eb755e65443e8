"""Queries on laid-out lines: elements, order, paragraphs, sections, boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.functions import rules
from evidra.operators import classify, graph, layout
from evidra.plans import sql
from evidra.plans.catalog import query
from evidra.plans.documents import TYPED, typed_lines
from evidra.sources import views
from evidra.sources.views import table


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.layout(table(spark, sf_dir, "documents"))


def _sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sectioned(views.dealt_lines(table(spark, sf_dir, "documents")))


_S = sql.strip("text")
_ELEMENT = f"""CASE WHEN {_S} = '' THEN 'empty' WHEN (y0 + y1) / 2 > 684 THEN 'footer' WHEN (y0 + y1) / 2 < 28.8 AND length({_S}) < 50 THEN 'page_header'
  WHEN font_size >= max_font * 0.9 AND font_size > avg_font * 1.3 AND length({_S}) < 120 THEN 'heading'
  WHEN font_size > avg_font * 1.15 AND is_bold AND length({_S}) < 100 THEN 'subheading'
  WHEN {sql.any_match(_S, rules.LIST_ITEMS)} THEN 'list_item' WHEN regexp_matches({_S}, {sql.text(rules.CAPTION)}) THEN 'caption'
  WHEN font_size < avg_font * 0.8 THEN 'footnote' ELSE 'body' END"""
ELEMENTS = f""", fonts AS (SELECT *, avg(font_size) OVER p AS avg_font, max(font_size) OVER p AS max_font FROM layout WINDOW p AS (PARTITION BY doc_id, page)),
  elements AS (SELECT *, {_ELEMENT} AS element_type FROM fonts)"""


@query(f"WITH {sql.LAYOUT}{ELEMENTS} SELECT doc_id, pos, element_type FROM elements")
def element_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element type of every line."""
    return classify.with_elements(_layout(spark, sf_dir)).select("doc_id", "pos", "element_type")


@query(f"WITH {sql.LAYOUT} SELECT doc_id, pos, CASE WHEN conf10 < 8 THEN 'low' ELSE 'high' END AS reliability FROM layout")
def reliability_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability of every line."""
    return _layout(spark, sf_dir).select("doc_id", "pos", classify.reliability(F.col("confidence")).alias("reliability"))


@query(f"""WITH {sql.LAYOUT}
SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, page ORDER BY round_even(y0 / 5, 0) * 5, x0, pos)::INTEGER AS reading_order FROM layout""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading order on each page."""
    return layout.reading_order(_layout(spark, sf_dir)).select("doc_id", "pos", "reading_order")


@query(f"""WITH {sql.LAYOUT}, e AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, page) AS edge FROM layout),
  c AS (SELECT *, CASE WHEN (x0 + x1) / 2 > edge / 2 + 50 THEN 1 ELSE 0 END AS col FROM e)
SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY page, col, round_even(y0 / 10, 0) * 10, pos)::INTEGER AS reading_order FROM c""")
def column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading order that respects two columns."""
    return layout.column_order(_layout(spark, sf_dir)).select("doc_id", "pos", "reading_order")


@query(f"""WITH {sql.LAYOUT}, t AS (SELECT *, font_size >= max(font_size) OVER (PARTITION BY doc_id) - 1 AS large FROM layout WHERE page = 1 AND y0 < 250 AND trim(text) <> ''),
  m AS (SELECT *, max(large::INT) OVER o AS started FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY y0, x0, pos)),
  s AS (SELECT *, max(CASE WHEN NOT large AND started = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY y0, x0, pos) AS stopped FROM m),
  k AS (SELECT doc_id, {_S} AS part, min(pos) AS place FROM s WHERE large AND stopped = 0 AND length({_S}) > 2 GROUP BY ALL)
SELECT doc_id, left(string_agg(part, ' ' ORDER BY place), 250) AS title FROM k GROUP BY doc_id""")
def title_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title of each document."""
    return layout.detected_titles(_layout(spark, sf_dir))


_PARAGRAPHS = ELEMENTS + """, b AS (
  SELECT *, lag(element_type) OVER o AS was, lag(y0) OVER o AS py0, lag(y1) OVER o AS py1, lag(x0) OVER o AS px0 FROM elements WINDOW o AS (PARTITION BY doc_id, page ORDER BY pos)),
  opened AS (SELECT *, CASE WHEN was IS NULL OR element_type IN ('heading', 'subheading', 'caption') OR (was IN ('heading', 'subheading', 'caption') AND element_type <> was)
    OR y0 - py1 > (y1 - y0 + py1 - py0) / 2 * 1.8 OR (abs(x0 - px0) > 15 AND element_type = 'body') OR (element_type = 'list_item' AND was <> 'list_item') THEN 1 ELSE 0 END AS opens FROM b),
  paragraphs AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, page ORDER BY pos)::INTEGER AS paragraph FROM opened)"""


@query(f"WITH {sql.LAYOUT}{_PARAGRAPHS} SELECT doc_id, pos, paragraph FROM paragraphs")
def paragraph_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph of every line."""
    return layout.paragraphs(classify.with_elements(_layout(spark, sf_dir))).select("doc_id", "pos", "paragraph")


@query(f"""WITH {sql.LAYOUT}{_PARAGRAPHS} SELECT doc_id, page, paragraph, CASE WHEN bool_or(element_type = 'heading') THEN 'heading' WHEN bool_or(element_type = 'subheading') THEN 'subheading'
  WHEN bool_or(element_type = 'caption') THEN 'caption' WHEN bool_or(element_type = 'list_item') THEN 'list' WHEN bool_or(element_type IN ('footer', 'page_header')) THEN 'metadata'
  WHEN bool_or(element_type = 'footnote') THEN 'footnote' ELSE 'body' END AS category, count(*)::BIGINT AS line_count, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
FROM paragraphs GROUP BY doc_id, page, paragraph""")
def paragraph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category, size and box of every paragraph."""
    return layout.paragraph_summary(layout.paragraphs(classify.with_elements(_layout(spark, sf_dir))))


@query()
def visual_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visual line of every block: a fold with a running mean, which plain SQL can't express."""
    return layout.visual_lines(_layout(spark, sf_dir))


@query(f"""WITH {sql.LAYOUT}, t AS (SELECT doc_id, page, x0, y0, x1, y1 FROM layout WHERE pos % 7 = 0)
SELECT doc_id, pos FROM layout l WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = l.doc_id AND t.page = l.page
  AND l.x0 >= t.x0 - 5 AND l.y0 >= t.y0 - 5 AND l.x1 <= t.x1 + 5 AND l.y1 <= t.y1 + 5)""")
def outside_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that lie in no table box (indented lines play the tables)."""
    blocks = _layout(spark, sf_dir)
    return layout.outside_tables(blocks, blocks.where("pos % 7 = 0")).select("doc_id", "pos")


_RATIO = """greatest(0, least(o.x1, k.x1) - greatest(o.x0, k.x0)) * greatest(0, least(o.y1, k.y1) - greatest(o.y0, k.y0))
  / least(greatest(1, (o.x1 - o.x0) * (o.y1 - o.y0)), greatest(1, (k.x1 - k.x0) * (k.y1 - k.y0)))"""


@query(f"""WITH {sql.LAYOUT}, o AS (SELECT doc_id, page, pos, text, x0 + 30 AS x0, y0 + 5 AS y0, x1 + 30 AS x1, y1 + 5 AS y1 FROM layout WHERE pos % 2 = 0), k AS (SELECT * FROM layout WHERE pos % 3 = 0)
SELECT doc_id, pos FROM o WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = o.doc_id AND k.page = o.page AND ({_RATIO} > 0.5 OR (trim(o.text) = trim(k.text) AND {_RATIO} > 0.2)))""")
def ocr_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised lines (shifted copies of every other line) that no known block covers."""
    blocks = _layout(spark, sf_dir)
    shifted = blocks.where("pos % 2 = 0").select("doc_id", "page", "pos", "text", *[(F.col(c) + d).alias(c) for c, d in (("x0", 30), ("y0", 5), ("x1", 30), ("y1", 5))])
    return layout.new_ocr_lines(shifted, blocks.where("pos % 3 = 0")).select("doc_id", "pos")


@query("""WITH w AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS i, unnest(s) AS text FROM (SELECT doc_id, string_split(text, ' ') AS s FROM documents)),
  g AS (SELECT doc_id, i // 100 AS block_num, i // 10 % 10 AS line_num, i % 10 AS n, text, (i * 7) % 100 - 5 AS conf FROM w)
SELECT doc_id, block_num::INTEGER AS block_num, line_num::INTEGER AS line_num, string_agg(text, ' ' ORDER BY n) AS text, min(n * 50)::INTEGER AS x0, max(n * 50 + 45)::INTEGER AS x1,
  floor(coalesce(avg(conf) FILTER (WHERE conf > 0) / 100, 0.5) * 10000 + 0.5)::BIGINT AS confidence FROM g GROUP BY doc_id, block_num, line_num""")
def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as a recogniser reports them, put together to lines."""
    words = views.whole_texts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "text"))
    found = words.selectExpr(
        "doc_id", "1 AS page", "cast(i div 100 as int) AS block_num", "cast(i div 10 % 10 as int) AS line_num", "cast(i % 10 as int) AS word_no", "text",
        "cast(i % 10 * 50 as int) AS `left`", "cast(i div 10 % 10 * 15 as int) AS top", "45 AS width", "12 AS height", "(i * 7) % 100 - 5 AS conf",
    )
    return layout.ocr_lines(found).select("doc_id", "block_num", "line_num", "text", "x0", "x1", F.floor(F.col("confidence") * 10000 + 0.5).cast("long").alias("confidence"))


@query(f"WITH {sql.SECTIONED} SELECT doc_id, pos, section FROM sectioned")
def section_sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section of every line."""
    return _sectioned(spark, sf_dir).select("doc_id", "pos", "section")


@query(f"""WITH {sql.sectioned(7)}, n AS (SELECT *, lead(pos) OVER o AS next_pos, lead(page) OVER o AS np, lead(section) OVER o AS ns, lead(text) OVER o AS nt FROM sectioned WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, next_pos FROM n WHERE np = page + 1 AND ns = section AND NOT {sql.is_header("nt")}""")
def cross_page_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that go on on the next page; sections of seven lines, so that some reach over a page's end."""
    return layout.continuity(views.sectioned(views.lines(table(spark, sf_dir, "documents")), 7))


_SPANS = ", spans AS (SELECT doc_id, section, min(page) AS page_start, max(page) AS page_end, count(*)::BIGINT AS n_lines FROM sectioned GROUP BY doc_id, section)"


@query(f"""WITH {sql.SECTIONED}{_SPANS}, i AS (SELECT doc_id, pos AS image_id, page FROM paged WHERE pos % 13 = 0)
SELECT i.doc_id, i.image_id, coalesce(max(s.section)::VARCHAR, 'unassigned') AS section FROM i LEFT JOIN spans s ON s.doc_id = i.doc_id AND i.page BETWEEN s.page_start AND s.page_end GROUP BY ALL""")
def image_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section of every image (every thirteenth line plays one): a range join in which the last match counts."""
    sectioned = _sectioned(spark, sf_dir)
    spans = sectioned.groupBy("doc_id", "section").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    return layout.image_sections(sectioned.where("pos % 13 = 0").select("doc_id", F.col("pos").alias("image_id"), "page"), spans)


@query(f"""WITH {sql.LAYOUT}, i AS (SELECT doc_id, page, pos AS image_id, 72 AS x0, y0, 540 AS x1, y1 FROM layout WHERE pos % 13 = 0)
SELECT l.doc_id, i.image_id, l.pos FROM i JOIN layout l ON l.doc_id = i.doc_id AND l.page = i.page
WHERE sqrt(power((i.x0 + i.x1 - l.x0 - l.x1) / 2, 2) + power((i.y0 + i.y1 - l.y0 - l.y1) / 2, 2)) < 80""")
def image_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines near each image."""
    lines = _layout(spark, sf_dir)
    images = lines.where("pos % 13 = 0").select("doc_id", "page", F.col("pos").alias("image_id"), F.lit(72).alias("x0"), "y0", F.lit(540).alias("x1"), "y1")
    return layout.image_lines(images, lines, 80).select("doc_id", "image_id", "pos")


@query(f"""WITH {sql.LAYOUT}, l AS (SELECT * REPLACE (CASE WHEN pos % 5 = 0 THEN 'Figure ' || pos ELSE text END AS text) FROM layout), i AS (SELECT doc_id, page, pos AS image_id, 72 AS x0, y0, 540 AS x1, y1 FROM layout WHERE pos % 13 = 0)
SELECT l.doc_id, i.image_id, min(l.pos) AS caption_pos FROM i JOIN l ON l.doc_id = i.doc_id AND l.page = i.page
WHERE sqrt(power((i.x0 + i.x1 - l.x0 - l.x1) / 2, 2) + power((i.y0 + i.y1 - l.y0 - l.y1) / 2, 2)) < 250 AND regexp_matches({_S.replace("text", "l.text")}, {sql.text(rules.CAPTION)}) GROUP BY ALL""")
def caption_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caption of each image; every fifth line plays one."""
    lines = _layout(spark, sf_dir).withColumn("text", F.when(F.col("pos") % 5 == 0, F.concat(F.lit("Figure "), F.col("pos").cast("string"))).otherwise(F.col("text")))
    images = lines.where("pos % 13 = 0").select("doc_id", "page", F.col("pos").alias("image_id"), F.lit(72).alias("x0"), "y0", F.lit(540).alias("x1"), "y1")
    return layout.caption_lines(images, lines, 250)


@query(f"""WITH {sql.SECTIONED}, c AS (SELECT doc_id, pos, section, row_number() OVER o - 1 AS n, first(text) OVER o AS f FROM sectioned WINDOW o AS (PARTITION BY doc_id, section ORDER BY pos))
SELECT doc_id, pos, n::INTEGER AS order_in_section, 'sec_' || doc_id || '_' || section AS section_id, CASE WHEN {sql.is_header("f")} THEN {sql.strip("f")} ELSE 'Section ' || section END AS label FROM c""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their place and label."""
    return layout.components(_sectioned(spark, sf_dir))


@query(f"""WITH {sql.SECTIONED}, l AS (SELECT *, (pos % 40) * 18 AS y0 FROM sectioned), h AS (SELECT *, first(y0) OVER (PARTITION BY doc_id, page, section ORDER BY pos) AS head FROM l)
SELECT doc_id, page, pos, row_number() OVER (PARTITION BY doc_id, page ORDER BY head, section, pos)::INTEGER AS chain_order FROM h""")
def page_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order in which the lines of a page are embedded."""
    return layout.page_chains(_sectioned(spark, sf_dir), _layout(spark, sf_dir))


@query(f"""WITH {sql.LAYOUT}, g AS (SELECT doc_id, page, pos, (pos % 40 // 3) * 18 AS y0, (pos % 3) * 100 AS x0 FROM layout),
  o AS (SELECT *, CASE WHEN abs(y0 - lag(y0) OVER w) < 10 THEN 0 ELSE 1 END AS opens FROM g WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, x0, pos)),
  r AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, pos) AS r FROM o), c AS (SELECT doc_id, page, r, count(*) AS cells FROM r GROUP BY ALL HAVING count(*) >= 2)
SELECT doc_id, page, count(*)::BIGINT AS n_rows, max(cells)::BIGINT AS n_cols FROM c GROUP BY doc_id, page HAVING count(*) >= 2""")
def fallback_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables found by rows of cells on one height (lines set three to a row)."""
    grid = _layout(spark, sf_dir).withColumn("y0", F.expr("cast(pos % 40 div 3 * 18 as double)")).withColumn("x0", F.expr("cast(pos % 3 * 100 as double)"))
    return layout.cell_runs(grid)


@query(f"""WITH {sql.SECTIONED}{_SPANS}, f AS (SELECT doc_id, section, pos, text, row_number() OVER (PARTITION BY doc_id, section ORDER BY pos) AS r FROM sectioned)
SELECT s.doc_id, s.section, s.page_start, s.page_end, s.n_lines, string_agg(f.text, chr(10) ORDER BY f.pos) AS first_lines FROM spans s JOIN f USING (doc_id, section) WHERE f.r <= 50 GROUP BY ALL""")
def structure_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with their pages, number of lines and first fifty lines."""
    ordered = _sectioned(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("pos")))
    first = F.array_sort(F.collect_list(F.when(F.col("r") <= 50, F.struct("pos", "text"))))
    return ordered.groupBy("doc_id", "section").agg(
        F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.count(F.lit(1)).alias("n_lines"), F.array_join(F.transform(first, lambda x: x["text"]), "\n").alias("first_lines")
    )


@query(f"""WITH {sql.SECTIONED}, n AS (SELECT doc_id, pos, section, lead(pos) OVER o AS next_pos, lead(section) OVER o AS ns FROM sectioned WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, next_pos FROM n WHERE ns = section""")
def next_line_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain of lines inside sections."""
    return graph.next_lines(_sectioned(spark, sf_dir))


EDGES = """, secs AS (SELECT DISTINCT doc_id, section FROM sectioned), chain AS (
  SELECT doc_id, pos, section, lead(pos) OVER o AS np, lead(section) OVER o AS ns FROM sectioned WINDOW o AS (PARTITION BY doc_id ORDER BY pos)), edges AS (
  SELECT doc_id, 'doc:' || doc_id AS src, 'sec:' || section AS dst, 'BELONGS_TO' AS relationship, 0 AS write_seq FROM secs
  UNION ALL SELECT doc_id, 'sec:' || section, 'doc:' || doc_id, 'SECTION_SUMMARY_OF', 1 FROM secs
  UNION ALL SELECT * FROM (SELECT doc_id, 'sec:' || section, 'sec:' || lead(section) OVER (PARTITION BY doc_id ORDER BY section), 'NEXT_SECTION', 2 FROM secs) t(a, b, c, d, e) WHERE c IS NOT NULL
  UNION ALL SELECT doc_id, 'line:' || pos, 'sec:' || section, 'BELONGS_TO', 3 FROM sectioned
  UNION ALL SELECT doc_id, 'line:' || pos, 'line:' || np, 'NEXT_LINE', 4 FROM chain WHERE ns = section)"""


@query(f"WITH {sql.SECTIONED}{EDGES} SELECT doc_id, src, dst, arg_max(relationship, write_seq) AS relationship FROM edges GROUP BY doc_id, src, dst")
def structure_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the document tree, one for each pair of nodes."""
    return graph.collapse_edges(graph.structure_edges(_sectioned(spark, sf_dir)), "doc_id", "src", "dst")


@query(f"""WITH {sql.SECTIONED}, c AS (SELECT doc_id, pos, section, text, concat_ws(' ', lag(text, 2) OVER o, lag(text, 1) OVER o) AS b, concat_ws(' ', lead(text, 1) OVER o, lead(text, 2) OVER o) AS a
  FROM sectioned WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, concat_ws(' ', 'Section: Section ' || section || '.', CASE WHEN b <> '' THEN 'Previous: ' || b || '.' END, text, CASE WHEN a <> '' THEN 'Next: ' || a || '.' END) AS context FROM c""")
def context_window_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is embedded for every line."""
    return graph.context_text(_sectioned(spark, sf_dir))


@query(f"""WITH {sql.SECTIONED}, w AS (SELECT DISTINCT doc_id, section, unnest({sql.words("lower(text)")}) AS word FROM sectioned), t AS (SELECT * FROM w WHERE length(word) >= 5),
  z AS (SELECT doc_id, section, count(*) AS n FROM t GROUP BY ALL), c AS (SELECT a.doc_id, a.section AS s1, b.section AS s2, count(*)::BIGINT AS common FROM t a JOIN t b USING (doc_id, word) WHERE a.section < b.section GROUP BY ALL HAVING count(*) >= 3),
  f AS (SELECT c.* FROM c JOIN z z1 ON z1.doc_id = c.doc_id AND z1.section = s1 JOIN z z2 ON z2.doc_id = c.doc_id AND z2.section = s2 WHERE common / least(z1.n, z2.n) > 0.05)
SELECT doc_id, s1, s2, common FROM f UNION ALL SELECT doc_id, s2, s1, common FROM f""")
def topic_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that share words."""
    return graph.topic_bridges(_sectioned(spark, sf_dir))


_ROLL = f"""WITH {sql.SECTIONED}{TYPED.replace("FROM paged", "FROM sectioned")}, p AS (
  SELECT doc_id, section, information_type, count(*) AS n, min(pos) AS first_pos, sum(density) AS total, max(density) AS top FROM typed WHERE information_type IS NOT NULL GROUP BY ALL)
SELECT doc_id, section, string_agg(information_type || '=' || n, '|' ORDER BY information_type || '=' || n) AS distribution, arg_max(information_type, n * 1000000 - first_pos) AS dominant,
  floor(sum(total) / sum(n) + 0.5)::BIGINT AS avg_density, max(top)::BIGINT AS max_density FROM p GROUP BY doc_id, section"""


@query(_ROLL)
def type_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and densities of every section."""
    return graph.type_rollup(views.sectioned(typed_lines(spark, sf_dir)).where("information_type IS NOT NULL"), "doc_id", "section")


@query(f"""WITH {sql.SECTIONED}, a AS (SELECT doc_id, section, avg(6 + pos % 5) AS c FROM sectioned GROUP BY ALL)
SELECT doc_id, section, floor(c * 1000 + 0.5)::BIGINT AS confidence, CASE WHEN c < 7.9999995 THEN 'low' ELSE 'high' END AS flag FROM a""")
def confidence_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean confidence of every section."""
    lines = _sectioned(spark, sf_dir).withColumn("confidence", (F.lit(6) + F.col("pos") % 5) / 10)
    return graph.confidence_rollup(lines.select("doc_id", "section").distinct(), lines)


def _themes_sql(lines: str = sql.REPORTS, source: str = "reports") -> str:
    cases = [f"CASE WHEN {sql.any_of('three', t)} THEN {sql.text(label)} END" for label, (t, _) in rules.THEMES.items()]
    cases.append(f"CASE WHEN {sql.any_of('five', ['author', 'abstract', 'keyword', 'affiliation'])} THEN 'Document Metadata' END")
    return f"""{lines}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY pos) AS r FROM {source}),
  s AS (SELECT doc_id, section, lower(string_agg(text, ' ' ORDER BY pos) FILTER (WHERE r <= 3)) AS three, lower(string_agg(text, ' ' ORDER BY pos) FILTER (WHERE r <= 5)) AS five FROM r GROUP BY ALL),
  u AS (SELECT doc_id, section, unnest([{", ".join(cases)}]) AS theme FROM s), themes AS (SELECT doc_id, section, theme FROM u WHERE theme IS NOT NULL)"""


@query(f"""SELECT * FROM (WITH {_themes_sql(sql.SECTIONED, "sectioned")} SELECT doc_id, section, theme FROM themes)
UNION ALL SELECT * FROM (WITH {_themes_sql()} SELECT doc_id, section, theme FROM themes)""")
def heuristic_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes of the sections of documents and of reports."""
    return graph.heuristic_themes(_sectioned(spark, sf_dir)).unionByName(graph.heuristic_themes(views.report_lines(spark, sf_dir)))


_KEYWORDS = sorted({(label, w) for label, (_, keywords) in rules.THEMES.items() for k in keywords for w in k.split()} | {("Document Metadata", w) for w in rules.METADATA_THEME})
_MEMBERS = f"""keywords AS (SELECT * FROM (VALUES {", ".join(f"({sql.text(t)}, {sql.text(w)})" for t, w in _KEYWORDS)}) v(theme, word)), present AS (SELECT DISTINCT doc_id, theme FROM themes),
  spoken AS (SELECT doc_id, section, pos, unnest(list_distinct({sql.words("lower(text)")})) AS word FROM reports),
  hits AS (SELECT doc_id, section, pos, theme, count(*) AS n FROM spoken JOIN keywords USING (word) JOIN present USING (doc_id, theme) GROUP BY ALL
    UNION ALL SELECT doc_id, section, pos, theme, 1000 FROM reports JOIN themes USING (doc_id, section)),
  members AS (SELECT doc_id, section, pos, theme FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY n DESC, theme) = 1),
  few AS (SELECT * FROM members QUALIFY row_number() OVER (PARTITION BY doc_id, theme, section ORDER BY pos) <= 3)"""


@query(f"WITH {_themes_sql()}, {_MEMBERS} SELECT a.doc_id, a.theme, a.pos AS p1, b.pos AS p2 FROM few a JOIN few b ON a.doc_id = b.doc_id AND a.theme = b.theme AND a.section < b.section")
def semantic_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one theme in different sections of a report."""
    lines = views.report_lines(spark, sf_dir)
    return graph.semantic_alignment(graph.theme_members(lines, graph.heuristic_themes(lines)))
