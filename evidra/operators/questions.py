"""What a question asks for: intent, answer type, entities, expansions and the tests that steer retrieval."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidra.functions import rules
from evidra.functions.text import first_rule, has_any, literals, tokens, words


def intent(question: Column) -> Column:
    """Intent of a question."""
    return first_rule(F.lower(question), rules.INTENTS, F.lit("factual_lookup"))


def answer_type(question: Column) -> Column:
    """Kind of answer that is expected."""
    return first_rule(F.lower(question), rules.ANSWER_TYPES, F.lit("description"))


def requires_reasoning(intent_: Column) -> Column:
    """Whether an intent needs more than a look-up."""
    return intent_.isin(rules.REASONING_INTENTS)


def key_entities(question: Column) -> Column:
    """The first eight words that carry meaning."""
    found = F.regexp_extract_all(question, F.lit(r"\b[A-Za-z][A-Za-z0-9-]+\b"), 0)
    return F.slice(F.filter(found, lambda w: ~F.lower(w).isin(rules.ENTITY_STOP) & (F.char_length(w) > 2)), 1, 8)


def _triggered(question: Column) -> list[tuple[str, Column]]:
    every = F.array_union(words(F.lower(question)), F.transform(key_entities(question), lambda w: F.lower(w)))

    def named(trigger: str) -> Column:
        return F.exists(every, lambda w: (w == trigger) | ((F.char_length(w) >= 4) & F.contains(w, F.lit(trigger))))

    return [(trigger, named(trigger)) for trigger in rules.EXPANSIONS]


def expanded_claims(question: Column) -> Column:
    """The question and the phrasings that its concepts add, without repeats."""
    added = [F.when(test, literals(rules.EXPANSIONS[t][0])).otherwise(F.array().cast("array<string>")) for t, test in _triggered(question)]
    return F.array_distinct(F.concat(F.array(question), *added))


def expanded_terms(question: Column) -> Column:
    """Terms that a question's concepts add, without repeats."""
    added = [F.when(test, literals(rules.EXPANSIONS[t][1])).otherwise(F.array().cast("array<string>")) for t, test in _triggered(question)]
    return F.array_distinct(F.concat(*added))


def metadata_intents(question: Column) -> Column:
    """Kinds of document metadata that are asked for."""
    found = [F.when(has_any(F.lower(question), triggers), kind) for kind, triggers in rules.METADATA_TRIGGERS.items()]
    return F.array_compact(F.array(*found))


def is_factual(question: Column, intent_: Column, answer_type_: Column) -> Column:
    """Whether a short question asks for one value."""
    q = F.trim(question)
    n = F.size(words(q))
    short = intent_.isin("factual_lookup", "definition") & (n <= 8)
    return (n <= 12) & (q.rlike(rules.FACTUAL_START) | has_any(F.lower(q), rules.FACTUAL_KEYWORDS) | answer_type_.isin("name", "date", "number", "percentage", "entity") | short)


def is_metadata(question: Column) -> Column:
    """Whether a question is about the document itself."""
    return F.arrays_overlap(tokens(question), literals(rules.METADATA_KEYWORDS)) | has_any(F.lower(question), rules.METADATA_PHRASES)


def is_authorship(question: Column) -> Column:
    """Whether a question asks who made the document."""
    t = tokens(question)
    maker = F.arrays_overlap(t, literals(["who", "name", "names"])) & F.arrays_overlap(t, literals(["made", "built", "created", "developed", "wrote", "written"]))
    return F.arrays_overlap(t, literals(rules.AUTHORSHIP_KEYWORDS)) | maker | has_any(F.lower(question), rules.AUTHORSHIP_PHRASES)


def search_pool(intent_: Column) -> Column:
    """How many vector hits an intent looks at."""
    return F.coalesce(F.create_map(*[F.lit(v) for p in rules.SEARCH_POOL.items() for v in p])[intent_], F.lit(35))


def token_budget(question: Column, intent_: Column, answer_type_: Column, evidence: Column) -> Column:
    """Length of an answer: by intent, longer for long questions and much evidence. Whole numbers after each step."""
    base = F.coalesce(F.create_map(*[F.lit(v) for p in rules.TOKEN_BUDGETS.items() for v in p])[intent_], F.lit(1400))
    n = F.size(words(question))
    base = F.when(n > 30, F.floor(base * 14 / 10)).when(n > 15, F.floor(base * 12 / 10)).otherwise(base)
    base = F.when(evidence >= 15, F.floor(base * 125 / 100)).when(evidence >= 8, F.floor(base * 11 / 10)).otherwise(base)
    base = F.when(answer_type_.isin("list", "explanation", "summary"), F.greatest(base, F.lit(1800))).otherwise(base)
    return F.least(base, F.lit(4096)).cast("long")


def synthesis_budget(question: Column, items: Column) -> Column:
    """Length of an answer that a model makes of facts: by their number, longer for long questions."""
    base = F.when(items >= 20, 3200).when(items >= 12, 2400).when(items >= 6, 1800).otherwise(1400)
    n = F.size(words(question))
    return F.least(F.when(n > 30, F.floor(base * 135 / 100)).when(n > 15, F.floor(base * 115 / 100)).otherwise(base), F.lit(4096)).cast("long")
