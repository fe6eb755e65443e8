"""Tables and their cells, from HTML and from rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_html_table(html: Column) -> Column:
    """Rows of cell texts of a table's HTML."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)
    cells = lambda row: F.regexp_extract_all(row, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1)
    return F.transform(rows, lambda row: F.transform(cells(row), lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", ""))))


def cells_of(tables: DataFrame, rows: str = "rows") -> DataFrame:
    """Cells (table_id, row, col, text, is_header) of parsed tables; row 0 is the header."""
    by_row = tables.select("table_id", F.posexplode(rows).alias("row", "cells"))
    return by_row.select("table_id", "row", F.posexplode("cells").alias("col", "text")).withColumn("is_header", F.col("row") == 0)


def table_text(cells: DataFrame, limit: int = 4000) -> DataFrame:
    """What is embedded for a table: its cells in order as 'R0C1: text', cut at a length."""
    cell = F.concat(F.lit("R"), F.col("row").cast("string"), F.lit("C"), F.col("col").cast("string"), F.lit(": "), F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("row", "col", cell.alias("t"))))
    return cells.where("trim(text) <> ''").groupBy("table_id").agg(F.substring(F.array_join(F.transform(parts, lambda p: p["t"]), "; "), 1, limit).alias("text"))
