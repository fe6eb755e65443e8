"""Claims: facts and entities extracted from lines, and how they bear on one another.

Lines are (doc_id, section, pos, text). Claims carry the number of their rule and of the match within a line."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import rules
from evidra.functions.text import has_any, strip
from evidra.operators.graph import collapse_edges
from evidra.operators.paths import shortest_paths
from evidra.operators.substrings import contained
from evidra.sources import views

#: Documents with up to so many claims are paired inside one row; the claims of others are joined.
FEW = 512
CONTRADICTING = ("entity_date", "entity_money", "entity_statistic")


def extract(lines: DataFrame) -> DataFrame:
    """All claims of the lines, numbered c1, c2 ... in each document by line, rule and match. One pass over the text:
    every rule fills an array and the arrays are exploded together."""

    low = F.lower("text")
    digit = F.rlike("text", F.lit("[0-9]"))
    # What a line must hold for a rule to find anything: literal tests keep patterns from most lines.
    gates = {
        "entity_date": digit,
        "entity_money": digit & has_any(low, ["$", "usd", "eur", "gbp", "inr", "rs", "€", "£"]),
        "entity_statistic": F.contains("text", F.lit("%")),
        "entity_duration": digit & has_any(low, ["day", "week", "month", "year", "hr", "hour", "min"]),
        "entity_contact": F.contains("text", F.lit("@")),
    }
    defines = has_any(low, ["means", "is defined as", "refers to"])
    pairs = F.contains("text", F.lit(":"))

    def every(rule: int, kind: str, pattern: str, confidence: float):
        values = F.when(gates[kind], F.regexp_extract_all("text", F.lit(pattern), 0)).otherwise(F.array().cast("array<string>"))
        return F.transform(
            values, lambda v, i: F.struct(F.lit(rule).alias("rule"), i.alias("nth"), F.lit(kind).alias("claim_type"), v.alias("value"), F.lit(confidence).alias("confidence"))
        )

    found = [every(*rule) for rule in rules.CLAIM_PATTERNS]

    def single(rule: int, kind: str, value, test, confidence: float):
        one = F.struct(F.lit(rule).alias("rule"), F.lit(0).alias("nth"), F.lit(kind).alias("claim_type"), value.alias("value"), F.lit(confidence).alias("confidence"))
        return F.filter(F.array(F.when(test, one)), lambda x: x.isNotNull())

    group = lambda pattern, i: F.regexp_extract("text", pattern, i)
    definition = F.concat(strip(group(rules.DEFINITION_CLAIM, 1)), F.lit(" = "), strip(group(rules.DEFINITION_CLAIM, 2)))
    found.append(single(5, "fact_definition", definition, defines & F.col("text").rlike(rules.DEFINITION_CLAIM), 0.8))
    pair = F.concat(strip(group(rules.KEY_VALUE_CLAIM, 1)), F.lit(": "), strip(group(rules.KEY_VALUE_CLAIM, 2)))
    short = F.char_length(group(rules.KEY_VALUE_CLAIM, 2)) < 50
    found.append(single(6, "fact_specification", pair, pairs & F.col("text").rlike(rules.KEY_VALUE_CLAIM) & short, 0.75))
    claims = lines.select("doc_id", "section", "pos", F.explode(F.concat(*found)).alias("c")).select("doc_id", "section", "pos", "c.*")
    order = Window.partitionBy("doc_id").orderBy("pos", "rule", "nth")
    return claims.withColumn("claim_no", F.row_number().over(order))


def _pairs(claims: DataFrame, *keys: str) -> DataFrame:
    """Pairs of a document's claims, the earlier first, that agree in ``keys``. Merged, never broadcast: sizes are estimated
    from compressed tables before rows are exploded, and claims that pass for small ones would fill the driver."""
    a = claims.select(*keys, *[F.col(c).alias(f"a_{c}") for c in claims.columns if c not in keys])
    b = claims.select(*keys, *[F.col(c).alias(f"b_{c}") for c in claims.columns if c not in keys])
    return a.hint("merge").join(b.hint("merge"), list(keys)).where("a_claim_no < b_claim_no")


def supports(claims: DataFrame) -> DataFrame:
    """Pairs from one line support each other; others of one section are related. An equi-join on the section."""
    kind = F.when(F.col("a_pos") == F.col("b_pos"), "SUPPORTS").otherwise("RELATED_TO")
    return _pairs(claims, "doc_id", "section").select("doc_id", "a_claim_no", "b_claim_no", kind.alias("relationship"))


def contradictions(claims: DataFrame, kinds: tuple[str, ...] = CONTRADICTING) -> DataFrame:
    """Pairs of one kind and section that tell different values."""
    typed = claims.where(F.col("claim_type").isin(*kinds))
    return _pairs(typed, "doc_id", "section", "claim_type").where("a_value <> b_value").select("doc_id", "a_claim_no", "b_claim_no", F.lit("CONTRADICTS").alias("relationship"))


def linked(claims: DataFrame, least: int = 4) -> DataFrame:
    """Pairs of which the later value holds the earlier one (of more than ``least`` characters). Different values are
    looked up in each other first; claims that have them follow."""
    values = claims.select("doc_id", F.col("value").alias("needle")).where(F.char_length("needle") > least)
    held = contained(values, claims.select("doc_id", F.col("value").alias("text")), "doc_id")
    a = claims.select("doc_id", F.col("claim_no").alias("a_claim_no"), F.col("value").alias("needle"))
    b = claims.select("doc_id", F.col("claim_no").alias("b_claim_no"), F.col("value").alias("text"))
    pairs = held.join(a.hint("merge"), ["doc_id", "needle"]).join(b.hint("merge"), ["doc_id", "text"]).where("a_claim_no < b_claim_no")
    return pairs.select("doc_id", "a_claim_no", "b_claim_no", F.lit("LINKED_TO").alias("relationship"))


def depends(claims: DataFrame) -> DataFrame:
    """Claims whose value holds a term that another claim of the document defines; the last one that defines it counts."""
    term = F.lower(strip(F.element_at(F.split("value", "="), 1)))
    defined = claims.where((F.col("claim_type") == "fact_definition") & F.contains("value", F.lit("="))).select("doc_id", "claim_no", term.alias("needle"))
    terms = defined.groupBy("doc_id", "needle").agg(F.max("claim_no").alias("definition_no"))
    valued = claims.select("doc_id", "claim_no", F.lower("value").alias("text"))
    uses = contained(terms, valued, "doc_id", q=3).join(terms.hint("merge"), ["doc_id", "needle"]).join(valued.hint("merge"), ["doc_id", "text"])
    return uses.where("claim_no <> definition_no").select("doc_id", "claim_no", "definition_no").distinct()


def packed(claims: DataFrame) -> DataFrame:
    """Claims (numbered from 1 in each document) in rows of up to ``FEW`` of them: doc_id, ``most``, the document's highest
    number, ``part`` and ``claims``. Documents of few claims are one row each; claims that come as they were extracted need no
    exchange. What bears on each other in such a row is found there: nothing is posted, moved or joined."""
    sized = claims.withColumn("most", F.max("claim_no").over(Window.partitionBy("doc_id"))).withColumn("part", F.expr(f"(claim_no - 1) div {FEW}"))
    return sized.groupBy("doc_id", "most", "part").agg(F.collect_list(F.struct("claim_no", "section", "pos", "claim_type", "value")).alias("claims"))


def _inside(rows: DataFrame, here: Callable[[DataFrame], DataFrame], joined: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``here`` makes of ``packed`` rows that are whole documents and ``joined`` of the claims of all others. The rows are
    looked at for such others first, so they should come from a table."""
    few, many = here(rows.where(F.col("most") <= FEW)), rows.where(F.col("most") > FEW)
    return few if many.isEmpty() else few.unionByName(joined(many.select("doc_id", F.inline("claims"))))


def _both(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of the claims of a row, the earlier first."""
    return rows.select("doc_id", "claims", F.explode("claims").alias("a")).select("doc_id", "a", F.explode("claims").alias("b")).where("a.claim_no < b.claim_no")


def _same(*fields: str) -> Column:
    return reduce(Column.__and__, [F.col(f"a.{f}") == F.col(f"b.{f}") for f in fields])


def _holds(least: int = 4) -> Column:
    return (F.char_length("a.value") > least) & F.contains("b.value", F.col("a.value"))


def _related(rows: DataFrame, relationship: Column) -> DataFrame:
    found = _both(rows).select("doc_id", F.col("a.claim_no").alias("a_claim_no"), F.col("b.claim_no").alias("b_claim_no"), relationship.alias("relationship"))
    return found.where("relationship IS NOT NULL")


def packed_linked(rows: DataFrame) -> DataFrame:
    """``linked`` of ``packed`` rows."""
    return _inside(rows, lambda few: _related(few, F.when(_holds(), "LINKED_TO")), linked)


def packed_edges(rows: DataFrame) -> DataFrame:
    """``claim_edges`` of ``packed`` rows, the one written last for each pair."""
    against = _same("section", "claim_type") & F.col("a.claim_type").isin(*CONTRADICTING) & (F.col("a.value") != F.col("b.value"))
    beside = F.when(_same("section"), F.when(_same("pos"), "SUPPORTS").otherwise("RELATED_TO"))
    last = F.when(against, "CONTRADICTS").when(_holds(), "LINKED_TO").otherwise(beside)
    return _inside(rows, lambda few: _related(few, last), lambda many: collapse_edges(claim_edges(many), "doc_id", "a_claim_no", "b_claim_no"))


def packed_depends(rows: DataFrame) -> DataFrame:
    """``depends`` of ``packed`` rows."""

    def here(few: DataFrame) -> DataFrame:
        defining = F.filter("claims", lambda c: (c["claim_type"] == "fact_definition") & F.contains(c["value"], F.lit("=")))
        defined = F.transform(defining, lambda c: F.struct(F.lower(strip(F.element_at(F.split(c["value"], "="), 1))).alias("term"), c["claim_no"].alias("no")))
        valued = F.transform("claims", lambda c: F.struct(c["claim_no"].alias("no"), F.lower(c["value"]).alias("text")))
        made = few.select("doc_id", valued.alias("valued"), defined.alias("defined"))
        last = F.filter("defined", lambda t: (t["term"] != "") & ~F.exists("defined", lambda u: (u["term"] == t["term"]) & (u["no"] > t["no"])))
        asked = made.select("doc_id", "valued", F.explode(last).alias("t")).select("doc_id", "t", F.explode("valued").alias("c"))
        return asked.where((F.col("c.no") != F.col("t.no")) & F.contains("c.text", F.col("t.term"))).select("doc_id", F.col("c.no").alias("claim_no"), F.col("t.no").alias("definition_no"))

    return _inside(rows, here, depends)


def packed_links(rows: DataFrame) -> DataFrame:
    """Lines of ``packed`` rows' claims that support each other or are linked: (doc_id, pos, next_pos)."""

    def here(few: DataFrame) -> DataFrame:
        return _both(few).where(_same("section", "pos") | _holds()).select("doc_id", F.col("a.pos").alias("pos"), F.col("b.pos").alias("next_pos"))

    return _inside(rows, here, lambda many: line_links(many, supports(many).where("relationship = 'SUPPORTS'").unionByName(linked(many))))


def line_links(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between claims as links between their lines: (doc_id, pos, next_pos)."""
    from_ = claims.select("doc_id", "pos", F.col("claim_no").alias("a_claim_no"))
    to = claims.select("doc_id", F.col("pos").alias("next_pos"), F.col("claim_no").alias("b_claim_no"))
    return edges.join(from_.hint("merge"), ["doc_id", "a_claim_no"]).join(to.hint("merge"), ["doc_id", "b_claim_no"]).select("doc_id", "pos", "next_pos")


def section_evidence(claims: DataFrame, values: int = 20) -> DataFrame:
    """Per section: number of claims, counts by kind as text, and its first values joined. Of a section only a count for each
    kind and the first ``values`` are gathered; claims that come as they were extracted need no exchange."""
    first = F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("claim_no"))
    alike = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "section", "claim_type"))
    marked = claims.select("doc_id", "section", "claim_type", "value", first.alias("r"), F.concat_ws("=", "claim_type", alike.cast("string")).alias("kind"))
    shown = F.collect_list(F.when(F.col("r") <= values, F.struct("r", "value")))
    return marked.groupBy("doc_id", "section").agg(
        F.count(F.lit(1)).alias("claim_count"),
        F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("claim_types"),
        F.array_join(F.transform(F.array_sort(shown), lambda x: x["value"]), "; ").alias("facts_digest"),
    )


def claim_edges(claims: DataFrame) -> DataFrame:
    """All pair relationships with the order in which they are written; a later one replaces an earlier."""
    parts = [supports(claims), linked(claims), contradictions(claims)]
    return reduce(DataFrame.unionByName, [p.withColumn("write_seq", F.lit(i)) for i, p in enumerate(parts)])


def evidence_chains(claims: DataFrame, edges: DataFrame, window: int = 40) -> DataFrame:
    """Pairs of claim-bearing lines of different sections, fewer than ``window`` such lines apart, that a shortest path of
    two to four edges connects in the graph (doc_id, src, dst): lines p1 and p2, chain_length (nodes) and via (the inner
    ones). Lines that are neighbours already make no chain."""
    bearing = views.dealt(claims.select("doc_id", "section", "pos")).distinct()
    later = F.collect_list(F.struct("section", "pos")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(1, window - 1))
    spread = bearing.select("doc_id", F.col("section").alias("s1"), F.col("pos").alias("p1"), later.alias("later")).select("doc_id", "s1", "p1", F.explode("later").alias("o"))
    line = lambda c: F.concat(F.lit("line:"), F.col(c).cast("string"))
    pairs = spread.where("s1 <> o.section").select("doc_id", line("p1").alias("a"), line("o.pos").alias("b"))
    found = shortest_paths(edges, pairs).where("steps >= 2")
    at = lambda c: F.substring(c, 6, 20).cast("int")
    return found.select("doc_id", at("a").alias("p1"), at("b").alias("p2"), (F.col("steps") + 1).alias("chain_length"), "via")
