"""Reading order, paragraphs, sections and boxes of laid-out lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import rules
from evidra.functions.text import strip
from evidra.sources.views import is_header

PAGE = ("doc_id", "page")


def inside(inner: str, outer: str, tolerance: float) -> Column:
    """Whether box ``inner`` (column prefix) lies in box ``outer``, give or take a tolerance."""
    a, b = (lambda s: F.col(f"{inner}{s}")), (lambda s: F.col(f"{outer}{s}"))
    return (a("x0") >= b("x0") - tolerance) & (a("y0") >= b("y0") - tolerance) & (a("x1") <= b("x1") + tolerance) & (a("y1") <= b("y1") + tolerance)


def overlap_ratio(one: str, other: str) -> Column:
    """Shared area over the smaller area (areas of at least 1)."""
    a, b = (lambda s: F.col(f"{one}{s}")), (lambda s: F.col(f"{other}{s}"))
    wide = F.greatest(F.lit(0.0), F.least(a("x1"), b("x1")) - F.greatest(a("x0"), b("x0")))
    high = F.greatest(F.lit(0.0), F.least(a("y1"), b("y1")) - F.greatest(a("y0"), b("y0")))
    area = lambda c: F.greatest(F.lit(1.0), (c("x1") - c("x0")) * (c("y1") - c("y0")))
    return wide * high / F.least(area(a), area(b))


def centre_distance(one: str, other: str) -> Column:
    """Distance of two boxes' centres."""
    a, b = (lambda s: F.col(f"{one}{s}")), (lambda s: F.col(f"{other}{s}"))
    dx, dy = (a("x0") + a("x1") - b("x0") - b("x1")) / 2, (a("y0") + a("y1") - b("y0") - b("y1")) / 2
    return F.sqrt(dx * dx + dy * dy)


def outside_tables(blocks: DataFrame, tables: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Blocks that lie in no table of their page."""
    boxes = tables.select(*PAGE, *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    b, t = blocks.alias("b"), boxes.alias("t")
    same_page = (F.col("b.doc_id") == F.col("t.doc_id")) & (F.col("b.page") == F.col("t.page"))
    box = lambda s: F.col(f"b.{s}")
    within = (box("x0") >= F.col("t_x0") - tolerance) & (box("y0") >= F.col("t_y0") - tolerance) & (box("x1") <= F.col("t_x1") + tolerance) & (box("y1") <= F.col("t_y1") + tolerance)
    return b.join(t, same_page & within, "left_anti")


def new_ocr_lines(ocr: DataFrame, blocks: DataFrame) -> DataFrame:
    """Recognised lines that no block of their page covers: overlap over a half, or over a fifth with the same text."""
    known = blocks.select(*PAGE, F.col("text").alias("k_text"), *[F.col(c).alias(f"k_{c}") for c in ("x0", "y0", "x1", "y1")])
    o = ocr.select("*", *[F.col(c).alias(f"o_{c}") for c in ("x0", "y0", "x1", "y1")]).alias("o")
    k = known.alias("k")
    ratio = overlap_ratio("o_", "k_")
    covered = (ratio > 0.5) | ((strip(F.col("o.text")) == strip(F.col("k_text"))) & (ratio > 0.2))
    return o.join(k, (F.col("o.doc_id") == F.col("k.doc_id")) & (F.col("o.page") == F.col("k.page")) & covered, "left_anti").select(*ocr.columns)


def ocr_lines(words: DataFrame) -> DataFrame:
    """Recognised words as lines: text in order, box around them, mean of the positive confidences (else a half)."""
    ordered = F.array_sort(F.collect_list(F.struct("word_no", "text")))
    return words.groupBy(*PAGE, "block_num", "line_num").agg(
        F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"),
        F.min("left").alias("x0"),
        F.min("top").alias("y0"),
        F.max(F.col("left") + F.col("width")).alias("x1"),
        F.max(F.col("top") + F.col("height")).alias("y1"),
        F.coalesce(F.avg(F.when(F.col("conf") > 0, F.col("conf"))) / 100, F.lit(0.5)).alias("confidence"),
    )


def reading_order(layout: DataFrame, row_height: int = 5) -> DataFrame:
    """Position of each line on its page, top to bottom in rows of equal height, then left to right."""
    key = F.bround(F.col("y0") / row_height, 0) * row_height
    return layout.withColumn("reading_order", F.row_number().over(Window.partitionBy(*PAGE).orderBy(key, "x0", "pos")))


def column_order(layout: DataFrame, margin: float = 50.0) -> DataFrame:
    """Order that reads a left column before a right one; lines about the page's middle count as left."""
    edge = F.max("x1").over(Window.partitionBy(*PAGE))
    column = F.when((F.col("x0") + F.col("x1")) / 2 > edge / 2 + margin, 1).otherwise(0)
    order = Window.partitionBy("doc_id").orderBy("page", "col", F.bround(F.col("y0") / 10, 0) * 10, "pos")
    return layout.withColumn("col", column).withColumn("reading_order", F.row_number().over(order))


def detected_titles(layout: DataFrame) -> DataFrame:
    """Title of each document: the largest lines at the top of its first page, up to the first smaller one."""
    top = layout.where("page = 1 AND y0 < 250 AND trim(text) <> ''")
    order = Window.partitionBy("doc_id").orderBy("y0", "x0", "pos")
    large = F.col("font_size") >= F.max("font_size").over(Window.partitionBy("doc_id")) - 1
    marked = top.withColumn("large", large.cast("int")).withColumn("started", F.max("large").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stopped = F.coalesce(F.max(((F.col("large") == 0) & (F.col("started") == 1)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    kept = marked.withColumn("stopped", stopped).where("large = 1 AND stopped = 0").where(F.char_length(strip(F.col("text"))) > 2)
    first = kept.groupBy("doc_id", strip(F.col("text")).alias("part")).agg(F.min(F.struct("y0", "x0", "pos")).alias("at"))
    parts = F.array_sort(F.collect_list(F.struct("at", "part")))
    return first.groupBy("doc_id").agg(F.substring(F.array_join(F.transform(parts, lambda p: p["part"]), " "), 1, 250).alias("title"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """Lines with their paragraph: a new one at a heading or caption, after one, after a gap, at an indent or list."""
    order = Window.partitionBy(*PAGE).orderBy("pos")
    before = lambda c: F.lag(c).over(order)
    kind, was = F.col("element_type"), before("element_type")
    lone = ["heading", "subheading", "caption"]
    height = (F.col("y1") - F.col("y0") + before("y1") - before("y0")) / 2
    opens = (
        was.isNull()
        | kind.isin(lone)
        | (was.isin(lone) & (kind != was))
        | (F.col("y0") - before("y1") > height * 1.8)
        | ((F.abs(F.col("x0") - before("x0")) > 15) & (kind == "body"))
        | ((kind == "list_item") & (was != "list_item"))
    )
    return lines.withColumn("opens", opens.cast("int")).withColumn("paragraph", F.sum("opens").over(order).cast("int")).drop("opens")


def paragraph_summary(lines: DataFrame) -> DataFrame:
    """Paragraphs: category, number of lines and box."""
    has = lambda *kinds: F.bool_or(F.col("element_type").isin(*kinds))
    category = (
        F.when(has("heading"), "heading")
        .when(has("subheading"), "subheading")
        .when(has("caption"), "caption")
        .when(has("list_item"), "list")
        .when(has("footer", "page_header"), "metadata")
        .when(has("footnote"), "footnote")
        .otherwise("body")
    )
    return lines.groupBy(*PAGE, "paragraph").agg(
        category.alias("category"), F.count(F.lit(1)).alias("line_count"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )


def visual_lines(blocks: DataFrame, height: float = 5.0) -> DataFrame:
    """Blocks grouped to visual lines: in (y0, x0) order, joined while the centre stays near the running mean of the
    group and the gap to the group's right edge stays small. An ordered fold over each page's blocks."""
    ordered = F.array_sort(F.collect_list(F.struct("y0", "x0", "x1", "y1", "pos")))
    width = F.max("x1").alias("page_width")
    pages = blocks.groupBy(*PAGE).agg(ordered.alias("blocks"), width)
    fold = f"""aggregate(blocks,
      named_struct('groups', cast(array() as array<struct<pos:int,g:int>>), 'g', 0, 'n', 0, 'mean', cast(0 as double), 'right', cast(0 as double)),
      (s, b) -> if(s.n > 0 AND abs((b.y0 + b.y1) / 2 - s.mean) <= {height} AND b.x0 - s.right <= greatest(0.06 * page_width, 40D),
        named_struct('groups', array_append(s.groups, named_struct('pos', b.pos, 'g', s.g)), 'g', s.g, 'n', s.n + 1,
                     'mean', (s.mean * s.n + (b.y0 + b.y1) / 2) / (s.n + 1), 'right', greatest(s.right, cast(b.x1 as double))),
        named_struct('groups', array_append(s.groups, named_struct('pos', b.pos, 'g', s.g + 1)), 'g', s.g + 1, 'n', 1,
                     'mean', (b.y0 + b.y1) / 2, 'right', cast(b.x1 as double))),
      s -> s.groups)"""
    return pages.select(*PAGE, F.explode(F.expr(fold)).alias("m")).select(*PAGE, "m.pos", F.col("m.g").alias("visual_line"))


def cell_runs(lines: DataFrame, gap: float = 10.0) -> DataFrame:
    """Tables that nobody marked: rows are lines on one height, tables are runs of rows with two cells or more."""
    order = Window.partitionBy(*PAGE).orderBy("y0", "x0", "pos")
    opens = F.coalesce((F.abs(F.col("y0") - F.lag("y0").over(order)) >= gap).cast("int"), F.lit(1))
    rows = lines.withColumn("opens", opens).withColumn("row", F.sum("opens").over(order))
    wide = rows.groupBy(*PAGE, "row").agg(F.count(F.lit(1)).alias("cells")).where("cells >= 2")
    return wide.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n_rows"), F.max("cells").alias("n_cols")).where("n_rows >= 2")


def image_sections(images: DataFrame, sections: DataFrame) -> DataFrame:
    """The last section of a document whose pages hold an image's page; without one, 'unassigned'."""
    i, s = images.alias("i"), sections.alias("s")
    within = (F.col("i.doc_id") == F.col("s.doc_id")) & F.col("i.page").between(F.col("s.page_start"), F.col("s.page_end"))
    found = i.join(s, within, "left").groupBy("i.doc_id", "i.image_id").agg(F.max("s.section").alias("section"))
    return found.select("doc_id", "image_id", F.coalesce(F.col("section").cast("string"), F.lit("unassigned")).alias("section"))


def image_lines(images: DataFrame, lines: DataFrame, near: float) -> DataFrame:
    """Pairs of an image and a line of its page whose centres are nearer than ``near``."""
    i = images.select("doc_id", "page", "image_id", *[F.col(c).alias(f"i_{c}") for c in ("x0", "y0", "x1", "y1")])
    ln = lines.select("doc_id", "page", "pos", "text", *[F.col(c).alias(f"l_{c}") for c in ("x0", "y0", "x1", "y1")])
    return i.join(ln, list(PAGE)).where(centre_distance("i_", "l_") < near)


def continuity(sectioned: DataFrame) -> DataFrame:
    """Lines that go on in the next line on the next page, in the same section, unless that one is a header."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    after = lambda c: F.lead(c).over(order)
    goes_on = (after("page") == F.col("page") + 1) & (after("section") == F.col("section")) & ~is_header(after("text"))
    return sectioned.withColumn("next_pos", after("pos")).withColumn("goes_on", goes_on).where("goes_on").select("doc_id", "pos", "next_pos")


def caption_lines(images: DataFrame, lines: DataFrame, near: float = 100.0) -> DataFrame:
    """The first line near each image that reads like a caption."""
    captions = image_lines(images, lines.where(strip(F.col("text")).rlike(rules.CAPTION)), near)
    return captions.groupBy("doc_id", "image_id").agg(F.min("pos").alias("caption_pos"))


def components(sectioned: DataFrame) -> DataFrame:
    """Lines as components: their place in the section (from 0), the section's id and the label they are shown with;
    a section is called by its first line if that is a header."""
    section = Window.partitionBy("doc_id", "section").orderBy("pos")
    first = F.first("text").over(section)
    title = F.when(is_header(first), strip(first)).otherwise(F.concat(F.lit("Section "), F.col("section").cast("string")))
    return sectioned.select(
        "doc_id", "pos", (F.row_number().over(section) - 1).alias("order_in_section"), F.concat_ws("_", F.lit("sec"), F.col("doc_id").cast("string"), F.col("section").cast("string")).alias("section_id"), title.alias("label")
    )


def image_components(images: DataFrame) -> DataFrame:
    """Images of 30 points a side or more with what is embedded for them; those without a description have no text."""
    known = F.coalesce(F.trim("llm_description"), F.lit("")) != ""
    text = F.substring(F.concat(F.lit("[Image on page "), F.col("page").cast("string"), F.lit("] "), F.trim("llm_description")), 1, 2000)
    large = images.where("x1 - x0 >= 30 AND y1 - y0 >= 30")
    return large.select("doc_id", "image_id", "page", F.when(known, "figure").otherwise("undetermined").alias("role"), F.when(known, text).alias("text"))


def page_chains(sectioned: DataFrame, layout: DataFrame) -> DataFrame:
    """Order in which a page's lines are embedded: its chains of one section by the height of their first line."""
    placed = sectioned.select("doc_id", "pos", "section").join(layout.select("doc_id", "page", "pos", "y0"), ["doc_id", "pos"])
    head = placed.withColumn("head_y0", F.first("y0").over(Window.partitionBy(*PAGE, "section").orderBy("pos")))
    return head.select("doc_id", "page", "pos", F.row_number().over(Window.partitionBy(*PAGE).orderBy("head_y0", "section", "pos")).alias("chain_order"))
