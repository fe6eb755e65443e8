"""What a reader gets: citations, facts with their sources, evidence views, and texts cut to a budget.

Evidence is (query_id, doc_id, pos, page, section, text, alignment_score[, confidence])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import rules
from evidra.functions.text import common, has_any, strip, tokens, words
from evidra.operators import answers


def within_budget(lines: DataFrame, budget: int, *group: str) -> DataFrame:
    """The first lines of each group whose lengths stay within a budget; the first that goes over ends the text."""
    order = Window.partitionBy(*group).orderBy("pos")
    sized = lines.where(strip(F.col("text")) != "").withColumn("total", F.sum(F.char_length(strip(F.col("text")))).over(order))
    return sized.where(F.col("total") <= budget).drop("total")


def budget_text(lines: DataFrame, budget: int, *group: str) -> DataFrame:
    """Those lines as one text a group."""
    parts = F.array_sort(F.collect_list(F.struct("pos", strip(F.col("text")).alias("t"))))
    return within_budget(lines, budget, *group).groupBy(*group).agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"))


def longest_sections(sectioned: DataFrame, k: int = 5) -> DataFrame:
    """The k longest sections of each document: those worth a summary."""
    sizes = sectioned.groupBy("doc_id", "section").agg(F.sum(F.char_length("text")).alias("n_chars"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n_chars"), "section")))
    return ranked.where(F.col("rank") <= k)


def citations(evidence: DataFrame) -> DataFrame:
    """Evidence that is cited: by falling alignment, once for each page, section and beginning of the text."""
    key = Window.partitionBy("query_id", "page", "section", F.substring(strip(F.col("text")), 1, 50)).orderBy(F.desc("alignment_score"), "doc_id", "pos")
    once = evidence.where(strip(F.col("text")) != "").withColumn("copy", F.row_number().over(key)).where("copy = 1").drop("copy")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("alignment_score"), "doc_id", "pos")))


def confidence_breakdown(evidence: DataFrame, cited: DataFrame, source_path: str = "evidence_graph") -> DataFrame:
    """Per question: mean confidence of citations (1 without any), mean alignment, grounding and coverage, in
    thousandths."""
    thousandths = lambda c: F.floor(c * 1000 + 0.5 + 1e-6).cast("long")
    items = evidence.groupBy("query_id").agg(F.avg("alignment_score").alias("a"), F.count(F.lit(1)).alias("n"))
    confident = cited.groupBy("query_id").agg((F.avg("citation_confidence") / 1000).alias("c"))
    joined = items.join(confident, "query_id", "left")
    return joined.select(
        "query_id",
        thousandths(F.coalesce("c", F.lit(1.0))).alias("overall"),
        thousandths(F.col("a")).alias("semantic_alignment"),
        F.lit(round(rules.GROUNDING.get(source_path, 0.5) * 1000)).cast("long").alias("source_grounding"),
        thousandths(F.least(F.col("n") / 10, F.lit(1.0))).alias("evidence_coverage"),
    )


def raw_view(evidence: DataFrame, k: int = 15) -> DataFrame:
    """The first k pieces of evidence with their text cut for display."""
    ranked = evidence.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("alignment_score"), "doc_id", "pos"))).where(F.col("rank") <= k)
    return ranked.where(strip(F.col("text")) != "").select("query_id", "rank", F.substring(strip(F.col("text")), 1, 500).alias("text"), "page", "section")


def subgraph(evidence: DataFrame, k: int = 15) -> DataFrame:
    """Edges of the picture of an answer: question to evidence, section to evidence, evidence to its neighbour on a
    page."""
    ranked = evidence.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("alignment_score"), "doc_id", "pos"))).where(F.col("rank") <= k)
    name = lambda kind, *c: F.concat_ws(":", F.lit(kind), *[F.col(x).cast("string") for x in c])
    item = name("evidence", "doc_id", "pos")
    following = F.lead(item).over(Window.partitionBy("query_id", "doc_id", "page").orderBy("rank"))
    parts = [
        ranked.select("query_id", name("query", "query_id").alias("src"), item.alias("dst"), F.lit("RETRIEVES").alias("relationship")),
        ranked.select("query_id", name("section", "doc_id", "section").alias("src"), item.alias("dst"), F.lit("CONTAINS").alias("relationship")),
        ranked.select("query_id", item.alias("src"), following.alias("dst"), F.lit("ADJACENT").alias("relationship")).where("dst IS NOT NULL"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def attribute_facts(facts: DataFrame, evidence: DataFrame, least: float = 0.10) -> DataFrame:
    """The evidence that fits each fact best: shared words, shared numbers and its alignment. Facts are (query_id, nth,
    fact); what no evidence supports enough is not grounded. Tokens are made before the join."""
    content = lambda c: F.filter(F.array_distinct(tokens(c)), lambda w: (F.char_length(w) > 1) & ~w.isin(rules.FACT_STOP))
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\d+\.?\d*%?"), 0))
    f = facts.select("query_id", "nth", "fact", content(F.col("fact")).alias("fw"), numbers(F.col("fact")).alias("fn"))
    e = evidence.select("query_id", "doc_id", "pos", "alignment_score", content(F.col("text")).alias("ew"), numbers(F.col("text")).alias("en"))
    share = lambda a, b: common(a, b) / F.greatest(F.size(a), F.lit(1))
    scored = f.join(e, "query_id", "left").withColumn("score", 0.45 * share(F.col("fw"), F.col("ew")) + 0.30 * share(F.col("fn"), F.col("en")) + 0.25 * F.col("alignment_score"))
    best = scored.groupBy("query_id", "nth", "fact").agg(F.max_by(F.struct("doc_id", "pos", "score"), F.struct(F.round("score", 9), -F.col("doc_id"), -F.col("pos"))).alias("b"))
    grounded = F.coalesce(F.col("b.score") >= least, F.lit(False))
    return best.select("query_id", "nth", "fact", F.when(grounded, F.col("b.doc_id")).alias("doc_id"), F.when(grounded, F.col("b.pos")).alias("pos"), grounded.alias("grounded"))


def authorship_context(typed: DataFrame, max_chars: int = 9000, max_lines: int = 45) -> DataFrame:
    """Per document: the lines that most likely tell who made it, in order, within a budget of characters and lines.
    Of lines that begin alike the best one counts."""
    text = strip(F.col("text"))
    n = F.size(words(text))
    score = (
        F.when(F.col("page") <= 2, 4).otherwise(0)
        + F.when(F.col("information_type").isin("metadata", "fact", "header"), 3).otherwise(0)
        + F.when(has_any(F.lower(text), rules.AUTHORSHIP_TERMS), 4).otherwise(0)
        + F.when(text.rlike(rules.EMAIL), 2).otherwise(0)
        + F.when(n.between(2, 24), 1).otherwise(0)
    )
    best = [F.desc("score"), "page", F.desc(F.char_length("t")), "pos"]
    scored = typed.where(text != "").select("doc_id", "pos", "page", text.alias("t"), score.alias("score"))
    once = scored.withColumn("c", F.row_number().over(Window.partitionBy("doc_id", F.lower(F.substring("t", 1, 120))).orderBy(*best))).where("c = 1")
    order = Window.partitionBy("doc_id").orderBy(*best)
    line = F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit("] "), F.col("t"))
    budgeted = once.withColumn("rank", F.row_number().over(order)).withColumn("total", F.sum(F.char_length(line) + 1).over(order))
    return budgeted.where((F.col("total") <= max_chars) & (F.col("rank") <= max_lines)).select("doc_id", "rank", "pos", line.alias("line"))


def extractive_answers(evidence: DataFrame, label_match: Column, least: float = 0.3) -> DataFrame:
    """The best span for each question, by the first of three ways that a line allows: the value of a 'label: value' line
    whose label names what is asked for; a line of up to 20 words with names or numbers that shares words with the question or
    their synonyms; a line of up to 25 words that shares words with it. Evidence also holds ``question``, and may hold its
    ``hints`` and ``expanded_hints``, made once a question; ``label_match`` scores its column ``label``. What a way
    looks at is only made for lines that the ways before have left, and of a question's lines the best of each task move."""
    pattern = r"^([A-Za-z][A-Za-z\s]{0,30})\s*[:\-–—]\s*(.+)"
    w = r"[\p{L}\p{N}_]"
    edge = f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))"
    found = lambda p: F.size(F.array_distinct(F.regexp_extract_all("line", F.lit(p), 0)))
    line = evidence.select("*", F.posexplode(F.split("text", "\n")).alias("nth", "line")).withColumn("line", strip(F.col("line"))).where("line <> ''")
    if "hints" not in line.columns:
        line = line.withColumns({"hints": answers.hint_words(F.col("question")), "expanded_hints": answers.expanded_hints(F.col("question"))})
    parts = line.withColumn("label", F.lower(strip(F.regexp_extract("line", pattern, 1)))).withColumn("value", F.when(F.col("label") != "", strip(F.regexp_extract("line", pattern, 2))))
    matched = parts.withColumn("match", F.when((F.col("label") != "") & (F.char_length("value") > 1), label_match))
    labelled = F.coalesce(F.col("match") >= 0.7, F.lit(False))
    seen = matched.withColumn("seen", F.when(~labelled, F.array_distinct(tokens(F.col("line"))))).withColumn("n", F.when(~labelled, F.size(words(F.col("line")))))
    counted = seen.withColumn("expanded", F.size(F.array_intersect("expanded_hints", "seen"))).withColumn("shared", F.size(F.array_intersect("hints", "seen")))
    may = (F.col("n") <= 20) & (F.col("expanded") > 0)
    valued = counted.withColumn("valuable", F.when(may, found(f"{edge}[A-Z][a-z]{{2,}}{edge}") + found(rf"{edge}\p{{Nd}}[\p{{Nd}}.,]*{edge}")))
    high, short = F.col("valuable") >= 1, (F.col("shared") > 0) & (F.col("n") <= 25)
    added = F.when(labelled, 0.3 + 0.12 * F.col("match")).when(high, 0.06 * F.col("expanded") + 0.04 * F.col("valuable")).when(short, 0.05 * F.col("shared"))
    scored = valued.withColumn("score", F.col("alignment_score") + added).withColumn("span", F.when(labelled, F.col("value")).otherwise(F.col("line")))
    order = F.struct((-F.round("score", 9)).alias("s"), "doc_id", "pos", "nth")
    best = scored.where(F.col("score") > least).groupBy("query_id").agg(F.min_by(F.struct("span", "doc_id", "pos"), order).alias("b"))
    return best.select("query_id", strip(F.regexp_replace("b.span", r"\.+$", "")).alias("answer"), "b.doc_id", "b.pos")


def step_log(source_path: Column, n_evidence: Column) -> Column:
    """What happened to a question, step by step."""
    steps = ["interpret", "retrieve", "rerank", "generate", "arbitrate", "format"]
    state = lambda s: F.when((n_evidence == 0) & F.lit(s in ("rerank", "generate")), "skipped").when((source_path == "none") & F.lit(s == "arbitrate"), "empty").otherwise("done")
    return F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(s).alias("name"), state(s).alias("status")) for i, s in enumerate(steps)])
