"""What lines, tables, images and pages are: rule chains over their text and looks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import rules
from evidra.functions.text import first_rule, has_any, matches_any, strip, words


def looked_at(text: Column) -> Column:
    """What the rules look at: the stripped text, the same in lower case, and its words."""
    stripped = strip(text)
    return F.struct(stripped.alias("stripped"), F.lower(stripped).alias("low"), words(stripped).alias("words"))


def with_looks(lines: DataFrame) -> DataFrame:
    """Lines with a column ``look``. A generator makes it, which the optimizer doesn't fold into the rules that use it:
    each line is stripped, lower-cased and split once, not once a rule."""
    return lines.select("*", F.explode(F.array(looked_at(F.col("text")))).alias("look"))


def information_type(text: Column, page: Column) -> Column:
    """Information type of a line; null for a blank one."""
    return type_of(looked_at(text), page)


def type_of(look: Column, page: Column) -> Column:
    """The same from what the rules look at; cheap tests come before patterns."""
    stripped = look["stripped"]
    early = page <= 2
    rest = (
        F.when(F.contains(stripped, F.lit("@")) & F.rlike(stripped, F.lit(rules.EMAIL)), "metadata")
        .when(early & (F.size(look["words"]) <= 25) & F.rlike(stripped, F.lit(rules.AFFILIATION)), "metadata")
        .when(early & F.size(look["words"]).between(2, 5) & F.rlike(stripped, F.lit(rules.PROPER_NAME)), "metadata")
        .otherwise("fact")
    )
    return F.when(stripped != "", first_rule(look["low"], rules.INFORMATION_TYPES, rest))


def semantic_density(text: Column, information_type_: Column) -> Column:
    """Information density of a line in ten-thousandths (0 to 10000)."""
    return density_of(looked_at(text), information_type_)


def density_of(look: Column, information_type_: Column) -> Column:
    """The same from what the rules look at."""
    w = look["words"]
    caps = F.size(F.filter(F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda x: x.rlike(r"^\p{Lu}")))
    numbers = F.size(F.filter(w, lambda x: x.rlike("[0-9]")))
    long = F.size(F.filter(w, lambda x: F.char_length(x) >= 9))
    weights = F.create_map(*[F.lit(v) for kind, weight in rules.DENSITY_WEIGHTS.items() for v in (kind, round(weight * 10000))])
    score = F.lit(5000) + F.least(F.lit(1200), caps * 250) + F.least(F.lit(1200), numbers * 400) + F.least(F.lit(800), long * 200)
    score = score + F.coalesce(weights[F.coalesce(information_type_, F.lit("fact"))], F.lit(0))
    score = F.when(F.size(w) < 3, F.floor(score * 3 / 10)).otherwise(score)
    return F.when(look["stripped"] == "", 0).otherwise(F.least(F.lit(10000), F.greatest(F.lit(0), score))).cast("long")


def table_type(cells: Column) -> Column:
    """Kind of a table by the text of its cells."""
    return first_rule(F.lower(cells), rules.TABLE_TYPES, F.lit("data_table"))


def image_type(description: Column) -> Column:
    """Kind of an image by its description."""
    return first_rule(F.lower(F.coalesce(description, F.lit(""))), rules.IMAGE_TYPES, F.lit("figure"))


def reliability(confidence: Column, threshold: float = 0.8) -> Column:
    """Flag of a confidence; a missing one counts as certain."""
    return F.when(F.round(F.coalesce(confidence, F.lit(1.0)), 6) < threshold, "low").otherwise("high")


def page_type(has_text: Column, has_images: Column, coverage: Column) -> Column:
    """Digital, scanned or mixed, from what a page holds."""
    return F.when(has_text & has_images, F.when(coverage > 0.8, "scanned").otherwise("mixed")).when(has_images, "scanned").when(has_text, "digital").otherwise("scanned")


def page_types(objects: DataFrame) -> DataFrame:
    """Page types from page objects: text, number and area of images, area of the page."""
    per_page = objects.groupBy("doc_id", "page").agg(
        (F.max(F.char_length(strip(F.col("text")))) > 5).alias("has_text"), (F.sum("n_images") > 0).alias("has_images"), (F.sum("image_area") / F.max("page_area")).alias("coverage")
    )
    return per_page.select("doc_id", "page", page_type(F.col("has_text"), F.col("has_images"), F.col("coverage")).alias("page_type"))


def element_type(page_height: float = 720.0) -> Column:
    """Element type of a line with a box and a font, next to its page's average and largest font."""
    text, size = strip(F.col("text")), F.col("font_size")
    centre = (F.col("y0") + F.col("y1")) / 2
    n = F.char_length(text)
    return (
        F.when(text == "", "empty")
        .when(centre > page_height * 0.95, "footer")
        .when((centre < page_height * 0.04) & (n < 50), "page_header")
        .when((size >= F.col("max_font") * 0.9) & (size > F.col("avg_font") * 1.3) & (n < 120), "heading")
        .when((size > F.col("avg_font") * 1.15) & F.col("is_bold") & (n < 100), "subheading")
        .when(matches_any(text, rules.LIST_ITEMS), "list_item")
        .when(text.rlike(rules.CAPTION), "caption")
        .when(size < F.col("avg_font") * 0.8, "footnote")
        .otherwise("body")
    )


def with_elements(layout: DataFrame, page_height: float = 720.0) -> DataFrame:
    """Lines with their page's font statistics and their element type."""
    page = Window.partitionBy("doc_id", "page")
    fonts = layout.withColumn("avg_font", F.avg("font_size").over(page)).withColumn("max_font", F.max("font_size").over(page))
    return fonts.withColumn("element_type", element_type(page_height))


def is_structural_noise(text: Column) -> Column:
    """Leaders, bare numbers, index lines and short headings in capitals."""
    s = strip(text)
    capitals = (F.upper(s) == s) & s.rlike(r"\p{L}") & ~s.rlike("[0-9]") & (F.size(words(s)) <= 3)
    return s.rlike(r"\.{4,}|-{4,}") | s.rlike(r"^[\d\.\s\-]+$") | (s.rlike(r"\.\s*\d+\s*$") & F.contains(s, F.lit("..."))) | capitals


def claims_no_evidence(answer: Column) -> Column:
    """Whether an answer says that the document doesn't tell; an empty one does."""
    return F.coalesce(answer, F.lit("")).eqNullSafe("") | has_any(F.lower(F.coalesce(answer, F.lit(""))), rules.NO_EVIDENCE)
