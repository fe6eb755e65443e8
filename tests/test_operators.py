"""Operators on small fixtures whose results were worked out by hand."""

import pytest
from pyspark.sql import functions as F

from evidra.functions import rules
from evidra.operators import answers, classify, claims, graph, layout, questions, retrieval, tables, vectors
from evidra.sources import views



def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "page", "kind"),
    [
        ("Machine learning is defined as a method of data analysis.", 1, "definition"),
        ("The accuracy was 93.1%", 3, "statistic"),
        ("We propose a new approach", 3, "methodology"),
        ("mail me: jane@host.org", 9, "metadata"),
        ("John A. Smith", 1, "metadata"),
        ("John A. Smith", 3, "fact"),
        ("Dept of Maths, University of Somewhere", 2, "metadata"),
        ("plain words", 5, "fact"),
        ("  ", 1, None),
    ],
)
def test_information_type(spark, text, page, kind):
    assert one(spark, classify.information_type(F.col("t"), F.col("p")), t=text, p=page) == kind


@pytest.mark.parametrize(
    ("text", "kind", "density"),
    [("", "fact", 0), ("Model", "fact", 1650), ("93.1%", "statistic", 2070), ("one two three", "fact", 5500), ("see Alpha Beta 12 34 extraordinary", "result", 7800)],
)
def test_semantic_density(spark, text, kind, density):
    assert one(spark, classify.semantic_density(F.col("t"), F.col("k")), t=text, k=kind) == density


def test_boxes(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 5.0, 15.0, 15.0), (0.0, 0.0, 10.0, 10.0, 10.0, 0.0, 20.0, 10.0)], ", ".join(f"{p}{c} double" for p in "ab" for c in ("x0", "y0", "x1", "y1")))
    got = df.select(layout.overlap_ratio("a", "b").alias("r"), F.round(layout.centre_distance("a", "b"), 2).alias("d"), layout.inside("a", "b", 5.0).alias("i")).collect()
    assert [(x.r, x.d, x.i) for x in got] == [(0.25, 7.07, True), (0.0, 10.0, False)]


def test_page_types(spark):
    rows = [(1, 1, "some text", 0, 0.0, 100.0), (1, 2, "", 1, 50.0, 100.0), (1, 3, "some text", 1, 81.0, 100.0), (1, 4, "some text", 1, 80.0, 100.0), (1, 5, "", 0, 0.0, 100.0), (1, 6, "12345", 0, 0.0, 100.0)]
    df = spark.createDataFrame(rows, "doc_id int, page int, text string, n_images int, image_area double, page_area double")
    assert {r.page: r.page_type for r in classify.page_types(df).collect()} == {1: "digital", 2: "scanned", 3: "scanned", 4: "mixed", 5: "scanned", 6: "scanned"}


def test_visual_lines_follow_the_running_mean(spark):
    rows = [(1, 1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 1, 12.0, 4.0, 20.0, 14.0), (1, 1, 2, 22.0, 8.0, 30.0, 18.0), (1, 1, 3, 0.0, 40.0, 9.0, 50.0), (1, 1, 4, 400.0, 40.0, 410.0, 50.0)]
    df = spark.createDataFrame(rows, "doc_id int, page int, pos int, x0 double, y0 double, x1 double, y1 double")
    groups = {r.pos: r.visual_line for r in layout.visual_lines(df).collect()}
    assert groups[0] == groups[1] and groups[2] != groups[1] and groups[3] not in (groups[2], groups[4])


def facts(spark, texts):
    return spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(texts)], "doc_id int, section int, pos int, text string")


def test_claims(spark):
    texts = ["Due 2024-01-31 or Jan 5, 2024", "Costs $1,234.50 or 12 rs", "Up 5.5% in 30 days", '"Term" means a short thing', "Label: value", "Label: " + "v" * 50, "me@x.org"]
    got = [(r.pos, r.claim_type, r.value, r.claim_no) for r in claims.extract(facts(spark, texts)).orderBy("claim_no").collect()]
    assert [g[:3] for g in got] == [
        (0, "entity_date", "2024-01-31"), (0, "entity_date", "Jan 5, 2024"), (1, "entity_money", "$1,234.50"), (1, "entity_money", "12 rs"),
        (2, "entity_statistic", "5.5%"), (2, "entity_duration", "30 days"), (3, "fact_definition", "Term = a short thing"), (4, "fact_specification", "Label: value"), (6, "entity_contact", "me@x.org"),
    ]
    assert [g[3] for g in got] == list(range(1, 10))


def test_claim_relations(spark):
    c = claims.extract(facts(spark, ["On 2024-01-31", "On 2024-02-01", "gizmo means a small tool", "kind: gizmo parts"]))
    edges = {(r.a_claim_no, r.b_claim_no): r.relationship for r in graph.collapse_edges(claims.claim_edges(c), "doc_id", "a_claim_no", "b_claim_no").collect()}
    assert edges[(1, 2)] == "CONTRADICTS" and edges[(1, 3)] == "RELATED_TO"
    assert [(r.claim_no, r.definition_no) for r in claims.depends(c).collect()] == [(4, 3)]
    summary = claims.section_evidence(c).first()
    assert summary.claim_count == 4 and summary.facts_digest.startswith("2024-01-31; 2024-02-01; gizmo = a small tool")


def test_definitions_link_to_uses(spark):
    lines = spark.createDataFrame([(1, 0, "A lattice is a regular grid"), (1, 1, "this a lattice shows"), (1, 2, "no use")], "doc_id int, pos int, text string")
    assert [(r.def_pos, r.use_pos, r.term) for r in graph.definition_uses(lines).collect()] == [(0, 1, "a lattice")]


@pytest.mark.parametrize(
    ("text", "intent", "kind", "entities"),
    [
        ("What is machine learning?", "definition", "description", ["machine", "learning"]),
        ("Compare BERT versus GPT", "comparative", "description", ["Compare", "BERT", "versus", "GPT"]),
        ("How many nodes are there?", "quantitative", "number", ["many", "nodes"]),
        ("Who wrote it?", "factual_lookup", "name", ["wrote"]),
        ("Why does it fail?", "causal", "explanation", ["fail"]),
    ],
)
def test_questions(spark, text, intent, kind, entities):
    t = F.col("t")
    assert one(spark, questions.intent(t), t=text) == intent
    assert one(spark, questions.answer_type(t), t=text) == kind
    assert one(spark, questions.key_entities(t), t=text) == entities


def test_question_expansion(spark):
    t = F.col("t")
    assert "written by" in one(spark, questions.expanded_claims(t), t="who are the authors")
    assert one(spark, questions.expanded_terms(t), t="nothing here") == []
    assert one(spark, questions.is_authorship(t), t="who built this") and one(spark, questions.is_metadata(t), t="what year?")
    assert one(spark, questions.metadata_intents(t), t="contact and doi") == ["email", "doi"]


def test_text_match(spark):
    match = retrieval.text_match(retrieval.question_parts(F.col("q")), retrieval.line_parts(F.col("t")))
    assert one(spark, match, q="deep neural networks", t="on deep neural networks") == 1.0
    assert one(spark, F.round(match, 4), q="deep red sea", t="the red sea is not so far") == round(2 / 3 + 0.3 * 2 / 3, 4)
    assert one(spark, match, q="a b", t="a b") == 0.0


def test_edges_weaken_scores(spark):
    c = spark.createDataFrame([(1, 1, 5, 0.5), (1, 1, 6, 0.1)], "query_id int, doc_id int, pos int, score double")
    e = spark.createDataFrame([(1, 5, 6, "NEXT_LINE"), (1, 6, 7, "UNKNOWN")], "doc_id int, pos int, next_pos int, relationship string")
    got = {r.pos: round(r.score, 4) for r in retrieval.expand_edges(c, e).collect()}
    assert got == {5: 0.5, 6: 0.475}


@pytest.mark.parametrize(
    ("a", "b", "path"),
    [("Machine learning is a subfield of AI.", "ML is an AI subfield that uses data.", "evidence_graph"), ("Machine learning is a subfield of AI.", "", "evidence_graph"), ("", "ML is an AI subfield that uses data.", "llm_direct"), ("", "", "none")],
)
def test_arbitration(spark, a, b, path):
    q = F.lit("What is machine learning?")
    score = lambda c: answers.answer_score(F.col(c), F.size(answers.facts(F.col(c))), q)
    assert one(spark, answers.arbitrate(F.col("a"), score("a"), F.col("b"), score("b"), F.lit(False)), a=a, b=b) == path


@pytest.mark.parametrize(
    ("a", "b", "flags", "path"),
    [
        (600, 300, {}, "evidence_graph"),  # dominates
        (600, 300, {"metadata": True, "deep": "d"}, "deep_analysis"),
        (600, 590, {"deep": "d"}, "deep_analysis"),
        (600, 590, {"deep": "d", "raw": False, "merged": "m"}, "merged"),
        (500, 590, {"merged": "m"}, "merged"),
        (500, 590, {}, "llm_direct"),
        (500, 590, {"metadata": True, "merged": "m"}, "evidence_graph"),
        (50, 590, {"deep": "d"}, "deep_analysis"),
        (50, 590, {"metadata": True}, "llm_direct"),
        (50, 590, {"authorship": True, "failsafe": "f", "deep": "d"}, "document_failsafe"),
        (500, 590, {"authorship": True, "failsafe": "f"}, "llm_direct"),
        (500, 590, {"authorship": True, "failsafe": "f", "raw": False}, "document_failsafe"),
        (0, 0, {"deep": "d"}, "deep_analysis"),
        (700, 0, {"deep": "d"}, "evidence_graph"),
        (0, 0, {}, "none"),
    ],
)
def test_arbitration_with_models(spark, a, b, flags, path):
    given = {"metadata": False, "authorship": False, "raw": True, "deep": None, "merged": None, "failsafe": None} | flags
    given = {k: F.lit(v).cast("string") if k in ("deep", "merged", "failsafe") else F.lit(v) for k, v in given.items()}
    text = lambda s: F.lit("x" if s else None).cast("string")
    chosen = answers.arbitrate(text(a), F.lit(a), text(b), F.lit(b), **given)
    said = answers.answer_of(F.col("p"), F.lit("ev"), F.lit("llm"), given["deep"], given["merged"], given["failsafe"])
    row = spark.range(1).select(chosen.alias("p")).select("p", said.alias("t")).first()
    texts = {"evidence_graph": "ev", "llm_direct": "llm", "none": "No information found in the document."} | flags
    assert row.p == path and row.t == texts[{"deep_analysis": "deep", "document_failsafe": "failsafe"}.get(path, path)]


def test_suggestions(spark):
    t = F.col("t")
    assert one(spark, answers.suggestions(t, F.lit(True)), t="<think>why?</think>A?\nno\n B? \nC?\nD?\nE?") == ["A?", "B?", "C?", "D?"]
    assert one(spark, answers.suggestions(t, F.lit(True)), t="nothing")[2] == "Who authored this document?"
    assert one(spark, answers.suggestions(t, F.lit(False)), t="A?")[1] == "Key takeaways?"


def test_answers(spark):
    t = F.col("t")
    assert one(spark, answers.facts(t), t="- First fact here. Too short! Second fact follows") == ["First fact here.", "Second fact follows"]
    assert one(spark, answers.answer_score(t, F.lit(0), F.lit("q")), t="No information found in it") == 50
    assert one(spark, answers.without_thoughts(t), t="<think>a</think>yes<reasoning>open") == "yes"
    assert one(spark, answers.facts_used(t), t="Answer\nFACTS_USED:\n- one\n• two\nend") == ["one", "two"]
    merged = answers.merge_facts(F.array(F.lit("Alpha beta"), F.lit("gamma")), F.array(F.lit("alpha"), F.lit("delta")))
    assert one(spark, merged, t="") == ["Alpha beta", "gamma", "delta"]
    assert one(spark, answers.label_matches(t, F.lit("who is the author")), t="Authors") == 1.0
    assert one(spark, classify.claims_no_evidence(t), t="It could not find that") is True


def test_tables(spark):
    html = "<table><tr><th>Model</th><th>Accuracy</th></tr><TR><td>BERT</td><td><b>93.1%</b></td></TR></table>"
    parsed = spark.createDataFrame([(1, html)], "table_id int, html string").select("table_id", tables.parse_html_table(F.col("html")).alias("rows"))
    cells = tables.cells_of(parsed)
    assert tables.table_text(cells).first().text == "R0C0: Model; R0C1: Accuracy; R1C0: BERT; R1C1: 93.1%"
    assert one(spark, classify.table_type(F.col("t")), t="Model Accuracy") == "performance_metrics"


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0])], "vec_id int, v array<float>")
    q = v.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    assert [r.vec_id for r in vectors.nearest(q, v, 2).orderBy("rank").collect()] == [2, 3]


def test_sections_open_at_headers(spark):
    docs = spark.createDataFrame([(1, "SECTION 1\na plain line that is not a header, being long: 1.\n2.1 Results\nmore, yes 5;")], "doc_id int, text string")
    assert [r.section for r in views.sectioned(views.lines(docs)).orderBy("pos").collect()] == [1, 1, 2, 2]


def test_vocabulary_is_complete():
    assert set(rules.INFORMATION_TYPES) | {"fact"} <= set(rules.DENSITY_WEIGHTS)


def test_rerank_and_cascade(spark):
    hits = spark.createDataFrame([(1, 1, i, 0.9 - i / 100) for i in range(50)], "query_id int, doc_id long, pos int, alignment_score double")
    kept = retrieval.cascade(hits, F.lit(None).cast("double")).orderBy("rank").collect()
    assert [r.pos for r in kept] == list(range(8))
    turned = retrieval.rerank(hits.where("pos < 3"), F.col("pos").cast("double"), 2).orderBy("rank").collect()
    assert [r.pos for r in turned] == [2, 1]


def test_images(spark):
    rows = [(1, "a", 1, 0.0, 0.0, 29.0, 50.0, "x"), (1, "b", 2, 0.0, 0.0, 30.0, 30.0, "a chart"), (1, "c", 3, 0.0, 0.0, 40.0, 40.0, None)]
    images = spark.createDataFrame(rows, "doc_id int, image_id string, page int, x0 double, y0 double, x1 double, y1 double, llm_description string")
    got = {r.image_id: (r.role, r.text) for r in layout.image_components(images).collect()}
    assert got == {"b": ("figure", "[Image on page 2] a chart"), "c": ("undetermined", None)}
