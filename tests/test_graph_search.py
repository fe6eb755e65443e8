"""The property graph, links, concepts and walks on literal rows."""

from pyspark.sql import functions as F

from evidra.operators import claims, concepts, graph, retrieval, vectors
from evidra.operators import property_graph as graphs

LINE = "doc_id long, pos int, section int, text string"


def test_the_last_written_edge_counts_and_polite_kinds_give_way(spark):
    rows = lambda kind, pairs: spark.createDataFrame([(1, a, b, kind, 0.5) for a, b in pairs], "doc_id long, src string, dst string, relationship string, similarity double")
    parts = [(rows("A", ["xy", "xz"]), False), (rows("P", ["xy", "uv"]), True), (rows("B", ["xy"]), False), (rows("Q", ["uv", "pq"]), True)]
    got = {(r.src, r.dst): r.relationship for r in graphs.collapsed(parts).collect()}
    assert got == {("x", "y"): "B", ("x", "z"): "A", ("u", "v"): "P", ("p", "q"): "Q"}


def test_kinds_of_edges(spark):
    lines = spark.createDataFrame(
        [(1, 0, 1, "Entropy is defined as disorder"), (1, 1, 1, "Due 2024-01-02"), (1, 2, 2, "entropy grows: results of 5 %"), (1, 3, 2, "Due 2024-01-02 and 7 %"), (2, 0, 1, "alone")], LINE
    )
    found = claims.extract(lines)
    members = spark.createDataFrame([(1, "T", 1, 0), (1, "T", 2, 2)], "doc_id long, theme string, section int, pos int")
    links = spark.createDataFrame([(1, 1, 3, 0.9), (1, 0, 2, 0.8)], "doc_id long, query_pos int, pos int, similarity double")
    edges = {(r.doc_id, r.src, r.dst): r.relationship for r in graphs.property_graph(lines, found, links, members).collect()}
    assert edges[1, "line:0", "line:2"] == "DEFINITION_USED_IN"  # written before the link, which gives way
    assert edges[1, "line:1", "line:3"] == "SEMANTICALLY_RELATED"  # so they are neighbours and make no chain
    assert edges[1, "line:1", "line:2"] == "EVIDENCE_CHAIN"
    assert edges[1, "theme:T", "line:0"] == "THEME_MEMBER" and edges[1, "doc:1", "sec:1"] == "BELONGS_TO" and edges[1, "sec:1", "sec:2"] == "NEXT_SECTION"
    assert {k[2] for k, v in edges.items() if v == "SUPPORTED_BY"} == {"line:0", "line:1", "line:2", "line:3"}
    assert "LINKED_TO" in edges.values() and "AGGREGATES" in edges.values() and "CONTRADICTS" in edges.values()
    walked = graphs.line_edges(spark.createDataFrame([(*k, v, 0.9) for k, v in edges.items()], "doc_id long, src string, dst string, relationship string, similarity double"))
    assert {(r.pos, r.next_pos) for r in walked.collect()} >= {(0, 2), (1, 3), (0, 1), (2, 3)}


def test_chains_tell_length_and_way(spark):
    found = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (1, 3, 30), (1, 2, 21)], "doc_id long, section int, pos int")
    edges = [("line:10", "sec:1"), ("line:20", "sec:2"), ("line:21", "sec:2"), ("line:30", "sec:3"), ("sec:1", "doc:1"), ("sec:2", "doc:1"), ("sec:3", "doc:1"), ("sec:1", "sec:2"), ("line:21", "line:30")]
    got = claims.evidence_chains(found, spark.createDataFrame([(1, *e) for e in edges], "doc_id long, src string, dst string"))
    # 21 and 30 are neighbours and make no chain; 20 reaches 30 by its section and line 21
    assert {(r.p1, r.p2, r.chain_length, tuple(r.via)) for r in got.collect()} == {
        (10, 20, 4, ("sec:1", "sec:2")), (10, 21, 4, ("sec:1", "sec:2")), (10, 30, 5, ("sec:1", "doc:1", "sec:3")), (20, 30, 4, ("sec:2", "line:21")),
    }


def test_semantic_links_of_each_document(spark):
    rows = [(d, p, p // 3, 9000 if p < 20 else 0, [1.0, float(p % 4), float(p % 2)]) for d in (1, 2) for p in range(40)] + [(3, 0, 0, 9000, [0.0, 0.0, 0.0])]
    lines = spark.createDataFrame(rows, "doc_id long, pos int, section int, density long, v array<double>")
    got = {(r.doc_id, r.query_pos, r.pos, r.similarity) for r in vectors.semantic_links(lines, tile=7).collect()}
    want = set()
    for d in (1, 2):
        mine = {p: (s, v) for doc, p, s, _, v in rows if doc == d}
        far = lambda a, b: round(max(0, 1 - sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5), 9)
        for q in range(15):
            near = sorted((far(mine[q][1], v), p) for p, (_, v) in mine.items())[:3]
            want |= {(d, q, p, round(1 - f, 4)) for f, p in near if p != q and mine[p][0] != mine[q][0] and f < 0.35}
    assert got == want and len(got) > 20


def test_concepts_weigh_words_of_long_phrases_more(spark):
    lines = spark.createDataFrame([(1, 0, 1, "Solar panel arrays, the panel. Solar heat of the panel"), (1, 1, 1, None)], LINE)
    got = [(r.concept, r.weight) for r in concepts.section_concepts(lines).orderBy("rank").collect()]
    # degree over frequency: solar 5/2, panel 5/3, arrays 3, heat 2
    assert got == [("solar panel arrays", round(1000 * (5 / 2 + 5 / 3 + 3))), ("solar heat", 4500), ("panel", 1667)]
    asked = spark.createDataFrame([(1, "Which Panel is best"), (2, "nothing"), (3, "of the")], "query_id long, text string")
    hits = concepts.concept_hits(concepts.section_concepts(lines), asked, lines)
    # the entity panel lies in two concepts, and the word of over three letters in one at least: 2 + 0.5 times 0.15
    assert {(r.query_id, r.pos, round(r.score, 3)) for r in hits.collect()} == {(1, 0, 0.375), (1, 1, 0.375)}


def test_aligned_lines_count_less_than_members(spark):
    asked = spark.createDataFrame([(1, "which method has the author")], "query_id long, text string")
    members = spark.createDataFrame([("Methods", 1, 7, "THEME_MEMBER"), ("Methods", 1, 8, "SEMANTIC_ALIGNMENT")], "theme string, doc_id long, pos int, relationship string")
    got = {r.pos: round(r.score, 3) for r in retrieval.theme_hits(members, {"Methods": "method approach"}, asked).collect()}
    assert got == {7: 0.25, 8: 0.2}


def test_walks_take_all_kinds(spark):
    hits = spark.createDataFrame([(1, 1, 5, 0.5)], "query_id int, doc_id long, pos int, score double")
    edges = spark.createDataFrame(
        [(1, "line:5", "line:6", "SEMANTICALLY_RELATED", 0.8), (1, "line:5", "line:7", "EVIDENCE_CHAIN", None), (1, "line:5", "sec:1", "BELONGS_TO", None), (1, "line:5", "line:8", "SUPPORTS", None)],
        "doc_id long, src string, dst string, relationship string, similarity double",
    )
    got = {r.pos: round(r.score, 4) for r in retrieval.expand_edges(hits, graphs.line_edges(edges)).collect()}
    assert got == {5: 0.5, 6: round(0.5 * 0.85 * 0.8, 4), 7: 0.375}


def test_members_and_alignment_need_a_theme(spark):
    lines = spark.createDataFrame([(1, 0, 1, "Results of it"), (1, 1, 2, "the outcome here"), (1, 2, 3, "plain")], LINE)
    members = graph.theme_members(lines, graph.heuristic_themes(lines))
    assert {(r.pos, r.theme) for r in members.collect()} == {(0, "Results & Findings"), (1, "Results & Findings")}
    assert [(r.p1, r.p2) for r in graph.semantic_alignment(members).select(F.col("p1"), F.col("p2")).collect()] == [(0, 1)]


def test_citations_keep_what_supports_or_fall_back(spark):
    from evidra.operators import answers

    rows = [
        (1, "The Bridge opened 1932", 1, 1, 0, "nothing alike", 0.1), (1, "The Bridge opened 1932", 2, 1, 1, "The Bridge opened 1932 in spring", 0.5), (1, "The Bridge opened 1932", 3, 1, 2, "the year 1932", 0.2),
        (2, "quite other words", 4, 1, 6, "none", 0.0), (2, "quite other words", 1, 1, 3, "none", 0.0), (2, "quite other words", 2, 1, 4, "none", 0.0), (2, "quite other words", 3, 1, 5, "none", 0.0),
        (3, "alpha beta gamma " + " ".join(f"w{i}" for i in range(60)), 1, 1, 7, "gamma x beta y alpha", 0.0),
    ]
    evidence = spark.createDataFrame(rows, "query_id int, answer string, rank int, doc_id long, pos int, text string, alignment_score double")
    got = {(r.query_id, r.nth, r.pos, round(r.support, 4), r.grounded) for r in answers.citations(evidence).collect()}
    # 1: all words, all pairs, both names and numbers; then a third of the words, and one of three names and numbers
    assert got == {
        (1, 1, 1, 0.9, True), (1, 2, 2, round(0.25 / 3 + 0.25 / 3 + 0.04, 4), True),
        (2, 1, 3, 0.0, False), (2, 2, 4, 0.0, False), (2, 3, 5, 0.0, False),
        (3, 1, 7, round(0.25 * 3 / 63, 4), True),
    }
