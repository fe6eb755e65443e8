"""Answers: facts in them, their scores, the choice between two paths, and what supports them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import rules
from evidra.functions.text import bigrams, common, has_any, literals, sentences, strip, tokens, words


def facts(answer: Column) -> Column:
    """The facts of an answer: its sentences of more than ten characters."""
    return sentences(F.coalesce(answer, F.lit("")), 10)


def answer_score(answer: Column, n_facts: Column, question: Column) -> Column:
    """Score of an answer in thousandths: length, facts, shared words, numbers and names, shared word pairs."""
    content = lambda c: F.filter(F.array_distinct(tokens(c)), lambda w: (F.char_length(w) > 2) & ~w.isin(rules.ANSWER_STOP))
    q = content(question)
    shared = F.least(common(q, content(answer)) / F.greatest(F.size(q), F.lit(1)), F.lit(1.0))
    numbers = F.size(F.regexp_extract_all(answer, F.lit(r"\d+\.?\d*%?"), 0))
    names = F.size(F.regexp_extract_all(answer, F.lit(r"\b[A-Z][A-Za-z]{2,}\b"), 0))
    pairs = bigrams(words(F.lower(question)))
    paired = F.least(common(pairs, bigrams(words(F.lower(answer)))) / F.greatest(F.size(pairs), F.lit(1)), F.lit(1.0))
    raw = (
        F.least(F.char_length(answer) / 500, F.lit(1.0)) * 0.20
        + F.least(n_facts / 5, F.lit(1.0)) * 0.25
        + shared * 0.30
        + F.least((numbers + names * 0.5) / 10, F.lit(1.0)) * 0.15
        + paired * 0.10
    )
    scored = F.when(has_any(F.lower(answer), rules.REFUSALS), 50).otherwise(F.floor(F.least(raw, F.lit(1.0)) * 1000 + 0.5))
    return F.when(F.coalesce(answer, F.lit("")) == "", 0).otherwise(scored).cast("long")


def path_status(answer: Column, score: Column) -> Column:
    """What became of a path: refused up to 100 thousandths (so also without any text), else empty or ok."""
    return F.when(score <= 100, "refused").when(F.coalesce(answer, F.lit("")) == "", "empty").otherwise("ok")


def arbitrate(
    evidence: Column, evidence_score: Column, direct: Column, direct_score: Column, metadata: Column,
    authorship: Column | None = None, raw: Column | None = None, deep: Column | None = None, merged: Column | None = None, failsafe: Column | None = None,
) -> Column:
    """Which path answers, from answers and scores in thousandths. ``raw`` tells whether there is raw evidence; ``deep``,
    ``merged`` and ``failsafe`` are answers of models that read raw evidence, the facts of both paths, and the document;
    without a model they are null, and the better of both paths answers.

    A question about authorship whose evidence is weak goes to the document. Raw evidence read in depth comes next where
    the question is about the document itself or evidence was refused, which is also what settles a model's claim that
    the document says nothing."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    given = lambda c: F.lit(False) if c is None else has(c)
    raw = F.lit(True) if raw is None else raw
    authorship = F.lit(False) if authorship is None else authorship
    refused_a, refused_b = evidence_score <= 100, direct_score <= 100
    deepened = raw & given(deep)
    weak = F.when((direct_score > evidence_score) & has(direct), "llm_direct").when(has(evidence) & (evidence_score > 0), "evidence_graph").otherwise("none")
    return (
        F.when(authorship & (~raw | refused_a) & given(failsafe), "document_failsafe")
        .when((metadata | refused_a) & deepened, "deep_analysis")
        .when(refused_a & refused_b, weak)
        .when(refused_a, "llm_direct")
        .when(metadata | (direct_score == 0), "evidence_graph")
        .when((evidence_score >= 550) & (evidence_score > direct_score * 1.4), "evidence_graph")
        .when(deepened, "deep_analysis")
        .when(given(merged), "merged")
        .when(evidence_score >= direct_score, "evidence_graph")
        .otherwise("llm_direct")
    )


def answer_of(path: Column, evidence: Column, direct: Column, deep: Column | None = None, merged: Column | None = None, failsafe: Column | None = None) -> Column:
    """The text of the path that answers."""
    texts = {"evidence_graph": evidence, "llm_direct": direct, "deep_analysis": deep, "merged": merged, "document_failsafe": failsafe}
    found = F.when(path == "none", "No information found in the document.")
    for name, text in texts.items():
        if text is not None:
            found = found.when(path == name, text)
    return found


def merge_facts(first: Column, second: Column) -> Column:
    """Facts of both paths in order, without those that equal, hold or lie in an earlier one. An ordered fold."""
    every = F.concat(F.coalesce(first, F.array().cast("array<string>")), F.coalesce(second, F.array().cast("array<string>")))

    def step(kept: Column, fact: Column) -> Column:
        key = F.trim(F.lower(fact))
        known = F.exists(kept, lambda k: F.contains(F.trim(F.lower(k)), key) | F.contains(key, F.trim(F.lower(k))))
        return F.when(known, kept).otherwise(F.array_append(kept, fact))

    return F.aggregate(every, F.array().cast("array<string>"), step)


def high_value_tokens(text: Column) -> Column:
    """Numbers, capitalised words and abbreviations."""
    found = [F.regexp_extract_all(text, F.lit(p), 0) for p in (r"\d+\.?\d*%?", r"\b[A-Z][A-Za-z]{2,}\b", r"\b[A-Z]{2,}\b")]
    return F.array_union(F.array_union(found[0], found[1]), found[2])


def _support(answer: Column, evidence: Column, alignment: Column) -> tuple[Column, Column]:
    """How far evidence supports an answer, and how many words they share."""
    kept = lambda c: F.filter(tokens(c), lambda w: (F.char_length(w) > 1) & ~w.isin(rules.CITATION_STOP))
    share = lambda a, b: common(a, b) / F.greatest(F.size(F.array_distinct(a)), F.lit(1))
    a, e = kept(answer), kept(evidence)
    score = 0.25 * share(a, e) + 0.30 * share(bigrams(a), bigrams(e)) + 0.25 * share(high_value_tokens(answer), high_value_tokens(evidence)) + 0.20 * alignment
    return score, common(a, e)


def attribution(answer: Column, evidence: Column, alignment: Column) -> Column:
    """How far evidence supports an answer: shared words, word pairs and high-value tokens, and its own score."""
    return _support(answer, evidence, alignment)[0]


def citations(evidence: DataFrame, least: float = 0.05, words_: int = 3, first: int = 3) -> DataFrame:
    """The evidence that an answer cites, best first (nth): what supports it more than ``least`` or shares ``words_`` words
    with it; where nothing does, the first few by rank. Evidence is (query_id, answer, rank, doc_id, pos, text,
    alignment_score)."""
    score, shared = _support(F.col("answer"), F.col("text"), F.col("alignment_score"))
    rated = evidence.select("query_id", "rank", "doc_id", "pos", F.round(score, 9).alias("support"), shared.alias("shared"))
    fits = (F.col("support") > least) | (F.col("shared") >= words_)
    any_fits = F.max(fits.cast("int")).over(Window.partitionBy("query_id")) == 1
    chosen = rated.withColumn("grounded", any_fits).where(F.when(F.col("grounded"), fits).otherwise(F.col("rank") <= first))
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("grounded"), -F.col("support")).otherwise(F.lit(0.0)), "rank")
    return chosen.withColumn("nth", F.row_number().over(order)).select("query_id", "nth", "doc_id", "pos", "support", "grounded")


def fallback_sentences(evidence: DataFrame, k: int = 3) -> DataFrame:
    """Without a model: the k sentences of a question's evidence that share most words with it.
    Evidence is (query_id, question, rank, text)."""
    content = lambda c: F.filter(F.array_distinct(tokens(c)), lambda w: (F.char_length(w) > 2) & ~w.isin(rules.RECALL_STOP))
    pieces = evidence.select("query_id", "question", "rank", F.posexplode(sentences(F.col("text"), 10)).alias("nth", "sentence"))
    scored = pieces.withColumn("overlap", common(content(F.col("question")), content(F.col("sentence")))).where("overlap > 0")
    once = scored.withColumn("seen", F.row_number().over(Window.partitionBy("query_id", "sentence").orderBy("rank", "nth"))).where("seen = 1")
    return once.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("overlap"), "rank", "nth"))).where(F.col("r") <= k)


def hint_words(question: Column) -> Column:
    """Words of a question that say what it asks for."""
    return F.filter(F.array_distinct(tokens(question)), lambda w: (F.char_length(w) > 2) & ~w.isin(rules.HINT_STOP))


def expanded_hints(question: Column) -> Column:
    """Those words and the labels that can stand for them."""
    asked = hint_words(question)
    none = F.array().cast("array<string>")
    added = [F.when(F.array_contains(asked, trigger), literals(names)).otherwise(none) for trigger, names in rules.LABEL_SYNONYMS.items()]
    return F.array_distinct(F.concat(asked, *added))


def label_matches(label: Column, question: Column, hints: Column | None = None) -> Column:
    """How well the label of a 'label: value' line names what a question asks for: 1 a word, 0.7 a beginning. ``hints``:
    its expanded hints, if they were made once for many lines."""
    expanded = expanded_hints(question) if hints is None else hints

    def one(word: Column, held: Column) -> Column:
        begins = F.exists(held, lambda h: (F.char_length(word) >= 4) & (F.char_length(h) >= 4) & (F.substring(word, 1, 4) == F.substring(h, 1, 4)))
        return F.when(F.array_contains(held, word), 1.0).when(begins, 0.7).otherwise(0.0)

    labelled = F.array_distinct(words(F.lower(label)))
    # The array of one item binds the hints, which would be made anew for each word.
    return F.transform(F.array(expanded), lambda held: F.aggregate(F.transform(labelled, lambda w: one(w, held)), F.lit(0.0), lambda s, x: s + x))[0]


def first_json(text: Column) -> Column:
    """The outermost braces of a model's reply."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def without_thoughts(text: Column) -> Column:
    """A model's reply without what it marks as thinking, also where the mark isn't closed."""
    closed = F.regexp_replace(text, r"(?is)<(think|thought|reasoning)>.*?</\1>", "")
    return F.trim(F.regexp_replace(closed, r"(?is)<(think|thought|reasoning)>.*$", ""))


def suggestions(reply: Column, keyed: Column) -> Column:
    """Questions to suggest: the first four lines of a model's reply that ask something; fixed ones where it gives none, and
    others without a model."""
    lines = F.transform(F.split(without_thoughts(F.coalesce(reply, F.lit(""))), "\n"), lambda x: strip(x))
    asked = F.filter(lines, lambda x: F.contains(x, F.lit("?")))
    return F.when(~keyed, literals(rules.SUGGESTED_WITHOUT_MODEL)).when(F.size(asked) == 0, literals(rules.SUGGESTED_WITHOUT_REPLY)).otherwise(F.slice(asked, 1, 4))


def facts_used(reply: Column) -> Column:
    """The bullet lines after the marker of a model's reply."""
    after = F.element_at(F.split(reply, r"FACTS_USED:?"), -1)
    bullets = F.filter(F.transform(F.split(after, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^[-•*]"))
    return F.when(F.contains(reply, F.lit("FACTS_USED")), F.transform(bullets, lambda b: F.trim(F.regexp_replace(b, r"^[-•*]\s*", "")))).otherwise(F.array().cast("array<string>"))
