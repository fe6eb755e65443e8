"""Relations that the operators work on, derived from the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.functions import rules
from evidra.functions.text import matches_any, strip

LINES_PER_PAGE, LINES_PER_SECTION = 40, 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt out by doc_id in as many parts as whole texts are: no exchange for rows that lie like this already."""
    return rows.repartition(_parts(rows.sparkSession), "doc_id")


def whole_texts(documents: DataFrame) -> DataFrame:
    """Documents dealt out by doc_id in many small parts: what is made of their words is grouped by document and needs no
    other exchange, so whole texts move instead of words, and a part's words fit in memory."""
    return dealt(documents)


def lines(documents: DataFrame) -> DataFrame:
    """The lines of documents with their position: the unit that everything else refers to."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text")).withColumn("page", F.expr(f"cast(pos div {LINES_PER_PAGE} + 1 as int)"))


def dealt_lines(documents: DataFrame) -> DataFrame:
    """The lines of documents that were dealt out whole: what is ordered or grouped by document needs no other exchange,
    and patterns on lines are spread over many tasks, however few parts the documents are read in."""
    return lines(whole_texts(documents))


def layout(documents: DataFrame) -> DataFrame:
    """Lines with boxes, fonts and recognition confidence, as a page scan would report them."""
    row = F.col("pos") % LINES_PER_PAGE
    x0 = F.lit(72) + F.when(F.col("pos") % 7 == 0, 20).otherwise(0)
    return (
        lines(documents)
        .withColumn("x0", x0.cast("double"))
        .withColumn("y0", (row * 18).cast("double"))
        .withColumn("x1", F.col("x0") + F.least(F.char_length("text") * 5, F.lit(468)))
        .withColumn("y1", F.col("y0") + 12)
        .withColumn("font_size", F.when(F.col("pos") % 10 == 0, 18.0).when(F.col("pos") % 7 == 0, 13.0).otherwise(11.0))
        .withColumn("is_bold", F.col("pos") % 7 == 0)
        .withColumn("confidence", F.lit(0.6) + (F.col("pos") % 5) * 0.1)
    )


def is_header(text: Column) -> Column:
    """Whether a line looks like a section header by its pattern. Length is tested first: patterns see short lines."""
    return (F.char_length(strip(text)) < 80) & matches_any(strip(text), rules.SECTION_HEADERS)


def sectioned(lines_: DataFrame, every: int = LINES_PER_SECTION) -> DataFrame:
    """Lines with their section: a new one at each header, at each ``every``-th line and at the start."""
    opens = is_header(F.col("text")) | (F.col("pos") % every == 0)
    order = Window.partitionBy("doc_id").orderBy("pos")
    return lines_.withColumn("opens", opens.cast("int")).withColumn("section", F.sum("opens").over(order).cast("int")).drop("opens")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders dealt out by customer in many parts. Their few compressed bytes are read by few tasks, while patterns on what is
    made of them take long; claims are numbered by document and need no other exchange, and a part's lines fit in memory."""
    made = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    return made.repartition(_parts(spark), "o_custkey")


def _parts(spark: SparkSession) -> int:
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def fact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences about orders and parts that hold dates, amounts, shares, durations, definitions and key-value pairs.
    A document per customer, a section per order."""
    orders = _orders(spark, sf_dir)
    ident = F.col("o_orderkey").cast("string")
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long")
    amount = F.concat(F.lit("$"), F.format_number(F.expr("cast(floor(o_totalprice) as bigint) % 1000"), 0), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    made = [
        F.concat(F.lit("Order placed on "), day, F.lit(" for "), amount),
        F.concat(F.lit("Priority: "), F.col("o_orderpriority")),
        F.concat(F.lit("Order "), ident, F.lit(" means a purchase of status "), F.col("o_orderstatus")),
        F.concat(F.lit("Discount of "), (F.col("o_orderkey") % 40).cast("string"), F.lit("% within "), (F.col("o_orderkey") % 90 + 1).cast("string"), F.lit(" days")),
        F.concat(F.lit("Contact buyer"), F.col("o_custkey").cast("string"), F.lit("@example.com about the order")),
    ]
    rows = orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("section"), F.posexplode(F.array(*made)).alias("nth", "text"))
    return rows.withColumn("pos", F.col("section") * 10 + F.col("nth")).drop("nth")


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports on customers' orders: a document per customer, a section per order, which its status titles."""
    orders = _orders(spark, sf_dir)
    ident = F.col("o_orderkey").cast("string")
    title = F.when(F.col("o_orderstatus") == "F", "Results of order ").when(F.col("o_orderstatus") == "O", "Shipping method of order ").otherwise("About order ")
    made = [
        F.concat(title, ident),
        F.concat(F.lit("Paid "), F.floor("o_totalprice").cast("string")),
        F.concat(F.lit("Rank "), F.col("o_orderpriority")),
        F.concat(F.lit("Outcome on "), F.date_format("o_orderdate", "yyyy-MM-dd")),
    ]
    rows = orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").cast("int").alias("section"), F.posexplode(F.array(*made)).alias("nth", "text"))
    return rows.withColumn("pos", F.col("section") * 10 + F.col("nth")).drop("nth")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions: the benchmark's texts and what users say in conversations."""
    bench = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("query_id"), "text")
    said = table(spark, sf_dir, "conversations").where("role = 'user'")
    return bench.unionByName(said.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("query_id"), "text"))
