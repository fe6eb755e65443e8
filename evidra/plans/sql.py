"""Pieces of DuckDB SQL that the oracles share. They build on the same fixed values, but not on the Spark code."""

from __future__ import annotations

from collections.abc import Iterable, Mapping


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("'", "''") + "'"


def any_of(expr: str, phrases: Iterable[str]) -> str:
    """Whether one of the phrases is contained."""
    return "(" + " OR ".join(f"contains({expr}, {text(p)})" for p in phrases) + ")"


def any_match(expr: str, patterns: Iterable[str]) -> str:
    """Whether one of the patterns is found."""
    return "(" + " OR ".join(f"regexp_matches({expr}, {text(p)})" for p in patterns) + ")"


def rule_chain(expr: str, rules: Mapping[str, list[str]], otherwise: str) -> str:
    """The first rule with a contained phrase."""
    return "CASE " + " ".join(f"WHEN {any_of(expr, phrases)} THEN {text(name)}" for name, phrases in rules.items()) + f" ELSE {otherwise} END"


def words(expr: str) -> str:
    """White-space delimited words."""
    return rf"list_filter(regexp_split_to_array({expr}, '\s+'), lambda w: w <> '')"


def tokens(expr: str) -> str:
    """Lower-cased runs of letters, digits and underscores."""
    return rf"regexp_extract_all(lower({expr}), '[\p{{L}}\p{{N}}_]+')"


def strip(expr: str) -> str:
    """Text without white space at its ends."""
    return f"trim({expr}, ' ' || chr(9) || chr(10) || chr(13))"


def listed(values: Iterable[str]) -> str:
    """A list of string literals."""
    return "[" + ", ".join(map(text, values)) + "]"


def mapped(expr: str, values: Mapping[str, object], otherwise: object) -> str:
    """A value looked up in fixed values."""
    return "CASE " + expr + " " + " ".join(f"WHEN {text(k)} THEN {v}" for k, v in values.items()) + f" ELSE {otherwise} END"


HEADERS = [r"(?i)^(MODULE|SECTION|CHAPTER|PART)\s+\d+", r"(?i)^\d+(\.\d+)*\s+[A-Z]", r"(?i)^[A-Z]{2,}(\s+[A-Z]{2,})*$", r"(?i)^Project:\s+.*", r"(?i)^Objective:?\s*.*"]

LINES = """lines AS (
  SELECT doc_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INTEGER AS pos, unnest(string_split(text, chr(10))) AS text FROM documents
), paged AS (SELECT *, (pos // 40 + 1)::INTEGER AS page FROM lines)"""

LAYOUT = (
    LINES
    + """, layout AS (
  SELECT doc_id, pos, text, page, (72 + CASE WHEN pos % 7 = 0 THEN 20 ELSE 0 END)::DOUBLE AS x0, ((pos % 40) * 18)::DOUBLE AS y0,
         (72 + CASE WHEN pos % 7 = 0 THEN 20 ELSE 0 END + least(length(text) * 5, 468))::DOUBLE AS x1, ((pos % 40) * 18 + 12)::DOUBLE AS y1,
         CASE WHEN pos % 10 = 0 THEN 18.0 WHEN pos % 7 = 0 THEN 13.0 ELSE 11.0 END::DOUBLE AS font_size, pos % 7 = 0 AS is_bold,
         (6 + pos % 5) AS conf10
  FROM paged)"""
)



def is_header(column: str) -> str:
    """Whether a line looks like a section header."""
    s = strip(column)
    return f"({any_match(s, HEADERS)} AND length({s}) < 80)"


def sectioned(every: int = 10) -> str:
    """Lines with their section."""
    return (
        LINES
        + f""", sectioned AS (
  SELECT *, sum(CASE WHEN {is_header("text")} OR pos % {every} = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos)::INTEGER AS section FROM paged)"""
    )


SECTIONED = sectioned()

REPORTS = """reports AS (
  SELECT o_custkey AS doc_id, o_orderkey::INTEGER AS section, (o_orderkey * 10 + generate_subscripts([1, 2, 3, 4], 1) - 1)::INTEGER AS pos, unnest([
    CASE o_orderstatus WHEN 'F' THEN 'Results of order ' WHEN 'O' THEN 'Shipping method of order ' ELSE 'About order ' END || o_orderkey,
    'Paid ' || floor(o_totalprice)::BIGINT, 'Rank ' || o_orderpriority, 'Outcome on ' || strftime(o_orderdate, '%Y-%m-%d')]) AS text
  FROM orders)"""

FACTS = """made AS (
  SELECT o_custkey AS doc_id, o_orderkey AS section, unnest([
    'Order placed on ' || strftime(o_orderdate, '%Y-%m-%d') || ' for $' || (floor(o_totalprice)::BIGINT % 1000)::VARCHAR || '.' || lpad((floor(o_totalprice * 100 + 0.5)::BIGINT % 100)::VARCHAR, 2, '0'),
    'Priority: ' || o_orderpriority,
    'Order ' || o_orderkey || ' means a purchase of status ' || o_orderstatus,
    'Discount of ' || (o_orderkey % 40) || '% within ' || (o_orderkey % 90 + 1) || ' days',
    'Contact buyer' || o_custkey || '@example.com about the order']) AS text, generate_subscripts([1, 2, 3, 4, 5], 1) - 1 AS nth
  FROM orders
), facts AS (SELECT doc_id, section, section * 10 + nth AS pos, text FROM made)"""

_ALL = r"""
  SELECT doc_id, section, pos, {rule} AS rule, unnest(range(len(v))) AS nth, {kind} AS claim_type, unnest(v) AS value
  FROM (SELECT *, regexp_extract_all(text, {pattern}) AS v FROM facts)"""


def claims(patterns: list, facts: str | None = None) -> str:
    """All claims of the fact lines, or of other lines (CTEs that end with ``facts``), numbered."""
    parts = [_ALL.format(rule=rule, kind=text(kind), pattern=text(pattern)) for rule, kind, pattern, _ in patterns]
    w = r"[\p{L}\p{N}_\s]+"
    definition = rf"""(?i)["']?({w})["']?\s+(?:means|is defined as|refers to)\s+([\p{{L}}\p{{N}}_\s,]+)"""
    pair = rf"^({w}):\s+([^.]+?)$"
    group = lambda p, i: strip(f"regexp_extract(text, {text(p)}, {i})")
    parts.append(f"SELECT doc_id, section, pos, 5, 0, 'fact_definition', {group(definition, 1)} || ' = ' || {group(definition, 2)} FROM facts WHERE regexp_matches(text, {text(definition)})")
    parts.append(
        f"SELECT doc_id, section, pos, 6, 0, 'fact_specification', {group(pair, 1)} || ': ' || {group(pair, 2)} FROM facts"
        f" WHERE regexp_matches(text, {text(pair)}) AND length(regexp_extract(text, {text(pair)}, 2)) < 50"
    )
    union = " UNION ALL ".join(parts)
    return (facts or FACTS) + f", found AS ({union}), claims AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, rule, nth) AS claim_no FROM found)"


QUESTIONS = """questions AS (
  SELECT 'b' || item_id AS query_id, text FROM benchmark UNION ALL
  SELECT 'c' || conv_id || '.' || turn, text FROM conversations WHERE role = 'user')"""
