"""Column functions on text: words, tokens, phrase tests, rule chains. All run in the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"


def strip(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.btrim(text, F.lit(" \t\r\n"))


def words(text: Column) -> Column:
    """White-space delimited words."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def has_any(text: Column, phrases: Iterable[str]) -> Column:
    """Whether the text contains one of the phrases."""
    return reduce(Column.__or__, [F.contains(text, F.lit(p)) for p in phrases])


def matches_any(text: Column, patterns: Iterable[str]) -> Column:
    """Whether one of the patterns is found."""
    return reduce(Column.__or__, [F.rlike(text, F.lit(p)) for p in patterns])


def first_rule(text: Column, rules: Mapping[str, list[str]], otherwise: Column) -> Column:
    """Name of the first rule of which the text contains a phrase."""
    chain = None
    for name, phrases in rules.items():
        test = has_any(text, phrases)
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return chain.otherwise(otherwise)


def literals(values: Iterable[str]) -> Column:
    """An array of constants."""
    return F.array(*[F.lit(v) for v in values])


def bigrams(items: Column) -> Column:
    """Distinct adjacent pairs of an array, as 'a b'."""
    pairs = F.zip_with(F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0))), F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def common(a: Column, b: Column) -> Column:
    """Number of distinct items that two arrays share."""
    return F.size(F.array_intersect(a, b))


def tenthousandths(score: Column) -> Column:
    """A score as a whole number of ten-thousandths, half up."""
    return F.floor(score * 10000 + 0.5).cast("long")


def sentences(text: Column, least: int) -> Column:
    """Sentences without list marks that are longer than ``least`` characters."""
    pieces = F.split(strip(text), r"(?<=[.!?])\s+")
    return F.filter(F.transform(pieces, lambda s: strip(F.btrim(strip(s), F.lit("-•*")))), lambda s: F.char_length(s) > least)
