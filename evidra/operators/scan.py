"""What page readers report, made into lines and cells: spans, tables, pages without blocks, and their union."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.text import has_any, strip


def mode(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, ties to the larger one. Counts are taken before values meet."""
    counts = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("_n", value)).alias(value))


def digital_lines(spans: DataFrame) -> DataFrame:
    """One record per line from its spans (doc_id, page, line_no, span_no, text, size, font): joined text, dominant size,
    bold and italic by the fonts' names, first font; next to it its page's average and largest size. Blank spans and
    lines drop out."""
    keys = ["doc_id", "page", "line_no"]
    used = spans.where(strip(F.col("text")) != "")
    page = Window.partitionBy("doc_id", "page")
    low = F.lower("font")
    joined = used.groupBy(*keys).agg(
        strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda s: s["text"]), "")).alias("text"),
        F.min_by("font", "span_no").alias("font_name"),
        F.bool_or(has_any(low, ["bold", "black"])).alias("is_bold"),
        F.bool_or(has_any(low, ["italic", "oblique"])).alias("is_italic"),
        F.sum("size").alias("_sizes"),
        F.count(F.lit(1)).alias("_spans"),
        F.max("size").alias("_top"),
    )
    fonts = joined.withColumn("avg_font", F.sum("_sizes").over(page) / F.sum("_spans").over(page)).withColumn("max_font", F.max("_top").over(page))
    order = Window.partitionBy("doc_id", "page").orderBy("line_no")
    sized = fonts.drop("_sizes", "_spans", "_top").join(mode(used.select(*keys, F.col("size").alias("font_size")), keys, "font_size"), keys)
    return sized.withColumn("sequence", F.row_number().over(order)).withColumn("confidence", F.lit(1.0))


def table_cells(tables: DataFrame) -> DataFrame:
    """Cells of tables (table_id, page, rows: array of arrays) as a table reader reports them: trimmed text, row 0 the
    header, a fixed confidence; next to each its table's numbers of rows and columns. Null cells are empty texts."""
    shaped = tables.withColumn("row_count", F.size("rows")).withColumn("col_count", F.array_max(F.transform("rows", F.size)))
    by_row = shaped.select("table_id", "page", "row_count", "col_count", F.posexplode("rows").alias("row", "cells"))
    cells = by_row.select("table_id", "page", "row", "row_count", "col_count", F.posexplode("cells").alias("col", "text"))
    return cells.withColumn("text", strip(F.coalesce("text", F.lit("")))).withColumn("is_header", F.col("row") == 0).withColumn("confidence", F.lit(0.95))


def fallback_lines(native: DataFrame, blocks: DataFrame) -> DataFrame:
    """The reader's plain lines (doc_id, page, ...) of pages on which no block was found."""
    return native.where(strip(F.col("text")) != "").join(blocks.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti").withColumn("source", F.lit("digital_fallback")).withColumn("confidence", F.lit(0.5))


def normalised_lines(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lines of a document from both sources in one sequence: cells with text by table and place, then blocks that no
    table box holds, page by page. cells: (doc_id, page, table_no, row, col, text); blocks: (doc_id, page, pos, text)."""
    name = lambda *c: F.concat_ws("_", *[F.col(x).cast("string") if x != "table" else F.lit(x) for x in c])
    of_cells = cells.where(strip(F.col("text")) != "").select("doc_id", "page", name("doc_id", "page", "table", "table_no", "row", "col").alias("line_id"), "text", F.lit(0).alias("kind"), F.col("table_no").alias("a"), F.col("row").alias("b"), F.col("col").alias("c"))
    of_blocks = blocks.where(strip(F.col("text")) != "").select("doc_id", "page", name("doc_id", "page", "pos").alias("line_id"), "text", F.lit(1).alias("kind"), F.col("pos").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"))
    order = Window.partitionBy("doc_id").orderBy("page", "kind", "a", "b", "c")
    every = of_cells.unionByName(of_blocks).withColumn("sequence", F.row_number().over(order))
    return every.select("doc_id", "page", "line_id", "text", F.when(F.col("kind") == 0, "table_cell").otherwise("paragraph").alias("source"), "sequence")


def font_statistics(lines: DataFrame) -> DataFrame:
    """Upper median and largest font size of each document. Sizes are few, so they are counted first, and the median is
    where the running count passes half."""
    counts = lines.where(F.col("font_size").isNotNull()).groupBy("doc_id", "font_size").agg(F.count(F.lit(1)).alias("n"))
    document = Window.partitionBy("doc_id")
    running = counts.withColumn("upto", F.sum("n").over(document.orderBy("font_size"))).withColumn("all", F.sum("n").over(document))
    upper = F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("font_size")))
    return running.groupBy("doc_id").agg(upper.alias("median_font"), F.max("font_size").alias("max_font"))
