"""The property graph: edges between lines, sections and concepts, and roll-ups along them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import rules
from evidra.functions.text import has_any, strip, words
from evidra.operators.substrings import contained


def with_next(sectioned: DataFrame) -> DataFrame:
    """Lines with the next one of their document (next_pos), null where that is in another section."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    return sectioned.withColumn("next_pos", F.when(F.lead("section").over(order) == F.col("section"), F.lead("pos").over(order)))


def next_lines(sectioned: DataFrame) -> DataFrame:
    """Edges from a line to the next of its document, if both are in one section."""
    return with_next(sectioned).where("next_pos IS NOT NULL").select("doc_id", "pos", "next_pos")


def next_sections(sectioned: DataFrame) -> DataFrame:
    """Edges from a section to the next of its document."""
    sections = sectioned.select("doc_id", "section").distinct()
    return sections.withColumn("next_section", F.lead("section").over(Window.partitionBy("doc_id").orderBy("section"))).where("next_section IS NOT NULL")


def structure_kinds(sectioned: DataFrame) -> list[DataFrame]:
    """Edges of the document tree and the chains, kind by kind in the order in which they are written."""
    name = lambda kind, *c: F.concat_ws(":", F.lit(kind), *[F.col(x).cast("string") for x in c])
    sections = sectioned.select("doc_id", "section").distinct()
    down = sections.select("doc_id", name("doc", "doc_id").alias("src"), name("sec", "section").alias("dst"), F.lit("BELONGS_TO").alias("relationship"), F.lit(0).alias("write_seq"))
    up = sections.select("doc_id", name("sec", "section").alias("src"), name("doc", "doc_id").alias("dst"), F.lit("SECTION_SUMMARY_OF").alias("relationship"), F.lit(1).alias("write_seq"))
    chain = next_sections(sectioned).select("doc_id", name("sec", "section").alias("src"), name("sec", "next_section").alias("dst"), F.lit("NEXT_SECTION").alias("relationship"), F.lit(2).alias("write_seq"))
    member = sectioned.select("doc_id", name("line", "pos").alias("src"), name("sec", "section").alias("dst"), F.lit("BELONGS_TO").alias("relationship"), F.lit(3).alias("write_seq"))
    order = next_lines(sectioned).select("doc_id", name("line", "pos").alias("src"), name("line", "next_pos").alias("dst"), F.lit("NEXT_LINE").alias("relationship"), F.lit(4).alias("write_seq"))
    return [down, up, chain, member, order]


def structure_edges(sectioned: DataFrame) -> DataFrame:
    """Edges of the document tree and the chains in one table, with their turn of writing."""
    return reduce(DataFrame.unionByName, structure_kinds(sectioned))


def paragraph_edges(lines: DataFrame) -> DataFrame:
    """Edges of paragraphs (lines: doc_id, page, paragraph, pos, section): to their lines, and to the sections of these,
    which they belong to and sum up, once each."""
    paragraph = F.concat_ws(":", F.lit("par"), F.col("page").cast("string"), F.col("paragraph").cast("string"))
    named = lines.select("doc_id", paragraph.alias("src"), F.concat(F.lit("line:"), F.col("pos").cast("string")).alias("line"), F.concat(F.lit("sec:"), F.col("section").cast("string")).alias("sec"))
    held = named.select("doc_id", "src", F.col("line").alias("dst"), F.lit("PARAGRAPH_CONTAINS").alias("relationship"))
    sections = named.select("doc_id", "src", F.col("sec").alias("dst")).distinct()
    both = F.explode(F.array(F.lit("BELONGS_TO"), F.lit("PARAGRAPH_SUMMARY_OF")))
    return held.unionByName(sections.select("doc_id", "src", "dst", both.alias("relationship")))


def table_edges(cells: DataFrame, sectioned: DataFrame) -> DataFrame:
    """Edges of tables (cells: doc_id, table_no, row, col, pos of the cell's line): cells to their table, tables to their
    document, and to the section of the first cell that has one."""
    table = F.concat(F.lit("table:"), F.col("table_no").cast("string"))
    of_cells = cells.select("doc_id", F.concat(F.lit("line:"), F.col("pos").cast("string")).alias("src"), table.alias("dst"), F.lit("TABLE_CELL_OF").alias("relationship"))
    of_document = cells.select("doc_id", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("src"), table.alias("dst"), F.lit("BELONGS_TO").alias("relationship")).distinct()
    placed = cells.join(sectioned.select("doc_id", "pos", "section"), ["doc_id", "pos"])
    first = placed.groupBy("doc_id", "table_no").agg(F.min_by("section", F.struct("row", "col")).alias("section"))
    context = first.select("doc_id", table.alias("src"), F.concat(F.lit("sec:"), F.col("section").cast("string")).alias("dst"), F.lit("TABLE_CONTEXT").alias("relationship"))
    return of_cells.unionByName(of_document).unionByName(context)


def collapse_edges(edges: DataFrame, *keys: str) -> DataFrame:
    """One edge for each pair of ``keys``: the one written last."""
    return edges.groupBy(*keys).agg(F.max_by("relationship", "write_seq").alias("relationship"))


def topic_bridges(sectioned: DataFrame, least_chars: int = 5, least_common: int = 3, least_ratio: float = 0.05) -> DataFrame:
    """Pairs of a document's sections that share words, in both directions. Words are made distinct per section, and only
    words that sections really share make pairs, from the list of a word's sections. All grouping is inside documents, so
    lines that were dealt out by document need no other exchange."""
    terms = sectioned.select("doc_id", "section", F.explode(F.array_distinct(words(F.lower("text")))).alias("word")).where(F.char_length("word") >= least_chars).distinct()
    sized = terms.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "section")))
    pairs = _later_pairs(sized, ["doc_id", "word"], F.struct("section", "size"))
    shared = pairs.groupBy("doc_id", "a", "b").agg(F.count(F.lit(1)).alias("common")).where(F.col("common") >= least_common)
    near = shared.where(F.col("common") / F.least("a.size", "b.size") > least_ratio)
    both = F.explode(F.array(F.struct(F.col("a.section").alias("s1"), F.col("b.section").alias("s2")), F.struct(F.col("b.section").alias("s1"), F.col("a.section").alias("s2"))))
    return near.select("doc_id", both.alias("s"), "common").select("doc_id", "s.s1", "s.s2", "common")


def _later_pairs(rows: DataFrame, keys: list[str], item: Column) -> DataFrame:
    """Pairs (keys, a, b) of different items of each group, the smaller first. A group's items are listed once; each item
    then meets those behind it, so no row holds more than the list."""
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items")).where(F.size("items") > 1)
    first = listed.select(*keys, "items", F.posexplode("items").alias("i", "a"))
    return first.select(*keys, "a", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("b"))


def definition_terms(lines: DataFrame) -> DataFrame:
    """Terms that lines define; the last line that defines a term counts, the first tells its place."""
    defining = lines.where(F.col("text").rlike(rules.DEFINITION_GATE) & F.col("text").rlike(rules.DEFINITION_TERM))
    term = F.lower(strip(F.regexp_extract("text", rules.DEFINITION_TERM, 1)))
    named = defining.select("doc_id", "pos", term.alias("term")).where(F.char_length("term") > 2)
    return named.groupBy("doc_id", "term").agg(F.max("pos").alias("def_pos"), F.min("pos").alias("first_pos"))


def definition_uses(lines: DataFrame) -> DataFrame:
    """Lines that use a term which another line defines; of several terms of one line the first defined counts."""
    terms = definition_terms(lines).withColumnRenamed("term", "needle")
    defining = terms.select("doc_id").distinct().hint("merge")  # lines of other documents needn't move
    low = lines.select("doc_id", "pos", F.lower("text").alias("text")).join(defining, "doc_id", "left_semi")
    uses = contained(terms, low, "doc_id", q=3).join(terms, ["doc_id", "needle"]).join(low, ["doc_id", "text"]).where("pos <> def_pos")
    first = Window.partitionBy("doc_id", "def_pos", "pos").orderBy("first_pos", "needle")
    return uses.withColumn("r", F.row_number().over(first)).where("r = 1").select("doc_id", "def_pos", F.col("pos").alias("use_pos"), F.col("needle").alias("term"))


def type_rollup(typed: DataFrame, *group: str) -> DataFrame:
    """Per group of lines: its types with their counts, the dominant type (ties: that seen first), mean and largest
    density. Two levels of aggregation; nothing but counts is gathered."""
    per_type = typed.groupBy(*group, "information_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.sum("density").alias("total"), F.max("density").alias("top")
    )
    return per_type.groupBy(*group).agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "information_type", F.col("n").cast("string")))), "|").alias("distribution"),
        F.max_by("information_type", F.struct("n", -F.col("first_pos"))).alias("dominant"),
        F.floor(F.sum("total") / F.sum("n") + 0.5).cast("long").alias("avg_density"),
        F.max("top").alias("max_density"),
    )


def confidence_rollup(sections: DataFrame, lines: DataFrame) -> DataFrame:
    """Mean confidence of each section's lines (1 without any) with its flag."""
    means = lines.groupBy("doc_id", "section").agg(F.avg("confidence").alias("c"))
    joined = sections.join(means, ["doc_id", "section"], "left").withColumn("c", F.coalesce("c", F.lit(1.0)))
    return joined.select("doc_id", "section", F.floor(F.col("c") * 10000 + 0.5).cast("long").alias("confidence"), F.when(F.round("c", 6) < 0.8, "low").otherwise("high").alias("flag"))


def context_text(sectioned: DataFrame) -> DataFrame:
    """What is embedded for a line: its section, two lines before it, itself, and two after it."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    before = F.concat_ws(" ", F.lag("text", 2).over(order), F.lag("text", 1).over(order))
    after = F.concat_ws(" ", F.lead("text", 1).over(order), F.lead("text", 2).over(order))
    return sectioned.select(
        "doc_id",
        "pos",
        F.concat_ws(
            " ",
            F.concat(F.lit("Section: Section "), F.col("section").cast("string"), F.lit(".")),
            F.when(before != "", F.concat(F.lit("Previous: "), before, F.lit("."))),
            F.col("text"),
            F.when(after != "", F.concat(F.lit("Next: "), after, F.lit("."))),
        ).alias("context"),
    )


def heuristic_themes(sectioned: DataFrame) -> DataFrame:
    """Sections of each theme, by triggers among the words of their first lines."""
    ordered = sectioned.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("pos")))
    texts = F.array_sort(F.collect_list(F.struct("r", "text")))
    sample = ordered.where("r <= 5").groupBy("doc_id", "section").agg(texts.alias("t"))
    joined = lambda n: F.lower(F.array_join(F.transform(F.slice("t", 1, n), lambda x: x["text"]), " "))
    sample = sample.select("doc_id", "section", joined(3).alias("three"), joined(5).alias("five"))
    names = [(label, triggers, "three") for label, (triggers, _) in rules.THEMES.items()]
    names.append(("Document Metadata", ["author", "abstract", "keyword", "affiliation"], "five"))
    tests = [F.when(has_any(F.col(where), triggers), label) for label, triggers, where in names]
    return sample.select("doc_id", "section", F.explode(F.array_compact(F.array(*tests))).alias("theme"))


def theme_members(sectioned: DataFrame, themes: DataFrame) -> DataFrame:
    """The theme of each line: that of its section first, else the one whose keywords it shares most."""
    keyword_rows = [(label, w) for label, (_, keywords) in rules.THEMES.items() for k in keywords for w in k.split()] + [("Document Metadata", w) for w in rules.METADATA_THEME]
    spark = sectioned.sparkSession
    keywords = spark.createDataFrame(sorted(set(keyword_rows)), "theme string, word string")  # a fixed list
    present = themes.select("doc_id", "theme").distinct()
    tokens = sectioned.select("doc_id", "section", "pos", F.explode(F.array_distinct(words(F.lower("text")))).alias("word"))
    hits = tokens.join(F.broadcast(keywords), "word").join(present, ["doc_id", "theme"]).groupBy("doc_id", "section", "pos", "theme").agg(F.count(F.lit(1)).alias("n"))
    own = sectioned.join(themes, ["doc_id", "section"]).select("doc_id", "section", "pos", "theme", F.lit(1000).cast("long").alias("n"))
    ranked = hits.unionByName(own).withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "pos").orderBy(F.desc("n"), "theme")))
    return ranked.where("r = 1").select("doc_id", "section", "pos", "theme")


def semantic_alignment(members: DataFrame, per_section: int = 3) -> DataFrame:
    """Pairs of lines of one theme in different sections, the first few of each section."""
    few = members.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "theme", "section").orderBy("pos"))).where(F.col("r") <= per_section)
    pairs = _later_pairs(few, ["doc_id", "theme"], F.struct("section", "pos"))
    return pairs.where("a.section < b.section").select("doc_id", "theme", F.col("a.pos").alias("p1"), F.col("b.pos").alias("p2"))
