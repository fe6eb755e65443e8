"""Candidate sources and page scans on literal rows: values are written out here, not taken from the library's tables."""

from pyspark.sql import functions as F

from evidra.operators import graph, questions, retrieval, scan

LINE = "doc_id long, pos int, text string"


def test_entity_words_count_more(spark):
    asked = spark.createDataFrame([(1, "Who built the Bridge quickly")], "query_id long, text string")
    lines = spark.createDataFrame(
        [
            (1, 0, "the bridge stands here today"),  # an entity: 1 exact, 1 entity, stems brid and bridg
            (1, 1, "bridges are long constructions"),  # stems only: 2 x 0.4 is too little
            (1, 2, "quickly built bridge"),  # three words, all of them entities, six stems
            (1, 3, "nothing of the kind in here"),
            (1, 4, "bridge"),  # too short
        ],
        LINE,
    )
    got = {r.pos: round(r.score, 2) for r in retrieval.keyword_recall(asked, lines).collect()}
    # 0.15 + 0.06 + 0.10 + 2 x 0.03 = 0.37; the other is above the limit of 0.55
    assert got == {0: 0.37, 2: 0.55}


def test_questions_about_the_document(spark):
    asked = ["What is this paper about", "which report is it", "show the manuscript", "more details please", "an article", "the metadata", "is this a document", "how tall is the bridge"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "i int, text string").select("i", questions.is_metadata(F.col("text")).alias("m")).collect()
    assert [r.m for r in sorted(rows)] == [True] * 7 + [False]


def test_similar_lines_and_boosts(spark):
    asked = spark.createDataFrame([(1, "define river stones")], "query_id long, text string")
    typed = spark.createDataFrame(
        [(1, 0, "river stones", 1, "definition", 5000), (1, 1, "river water flows slowly", 1, "fact", 0), (1, 2, "else entirely", 1, "fact", 0)],
        LINE + ", page int, information_type string, density long",
    )
    parts = retrieval.search_parts(asked)
    assert {(r.part, r.text, r.k, r.factor) for r in parts.collect()} == {("c0", "define river stones", 35, 1.0), ("e0", "define", 8, 0.8), ("e1", "river", 8, 0.8), ("e2", "stones", 8, 0.8)}
    hits = retrieval.vector_hits(parts, typed)
    cosine = {(r.part, r.pos): r.score for r in hits.collect()}
    assert abs(cosine["c0", 0] - 1 / (2 - 2 / 6**0.5)) < 1e-6 and abs(cosine["e1", 1] - 0.8 / (2 - 0.5)) < 1e-6 and ("c0", 2) not in cosine
    best = {r.pos: r.score for r in retrieval.merge_best([retrieval.boosted(hits, asked, typed)]).collect()}
    # intent and answer type are both "definition": 0.18 + 0.12, and 0.04 times a density of a half
    assert abs(best[0] - (1 / (2 - 2 / 6**0.5) + 0.02 + 0.30)) < 1e-6


def test_evidence_themes_and_backlinks(spark):
    asked = spark.createDataFrame([(1, "which method has the author"), (2, "of the")], "query_id long, text string")
    summaries = spark.createDataFrame([(1, 5, "author Jane; method tests"), (1, 6, "other words")], "doc_id long, section int, facts_digest string")
    found = spark.createDataFrame([(1, 5, 50, 1), (1, 5, 51, 2), (1, 6, 60, 3)], "doc_id long, section int, pos int, claim_no int")
    # the question shares author and method, both of them entities: 2 x 0.12 + 2 x 0.15
    assert {(r.query_id, r.pos, round(r.score, 2)) for r in retrieval.evidence_summary_hits(summaries, found, asked).collect()} == {(1, 50, 0.54), (1, 51, 0.54)}
    members = spark.createDataFrame([("Methods", 1, 7)], "theme string, doc_id long, pos int")
    assert [(r.query_id, round(r.score, 2)) for r in retrieval.theme_hits(members, {"Methods": "method approach"}, asked).collect()] == [(1, 0.25)]
    hits = spark.createDataFrame([(1, 1, 50, 0.5)], "query_id long, doc_id long, pos int, score double")
    edges = spark.createDataFrame([(1, 1, 2, "SUPPORTS"), (1, 1, 3, "CONTRADICTS")], "doc_id long, a_claim_no int, b_claim_no int, relationship string")
    assert [(r.pos, r.score) for r in retrieval.claim_backlinks(hits, found, edges).collect()] == [(51, 0.325)]


def test_spans_make_lines(spark):
    spans = [
        (1, 1, 1, 0, "Bold ", 12.0, "Sans-Bold"), (1, 1, 1, 1, "and ", 9.0, "Sans"), (1, 1, 1, 2, "plain ", 9.0, "Sans"), (1, 1, 1, 3, "  ", 30.0, "X-Italic"),
        (1, 1, 2, 0, " ", 9.0, "Sans"), (1, 1, 4, 0, "two", 8.0, "Serif-Oblique"), (1, 1, 4, 1, "!", 10.0, "Serif"),
    ]
    got = scan.digital_lines(spark.createDataFrame(spans, "doc_id long, page int, line_no int, span_no int, text string, size double, font string")).orderBy("line_no").collect()
    assert [(r.text, r.font_size, r.is_bold, r.is_italic, r.font_name, r.sequence, r.max_font) for r in got] == [
        ("Bold and plain", 9.0, True, False, "Sans-Bold", 1, 12.0), ("two!", 10.0, False, True, "Serif-Oblique", 2, 12.0),
    ]
    assert all(abs(r.avg_font - 48 / 5) < 1e-9 for r in got)


def test_upper_median_and_fallback(spark):
    sizes = [(1, 2.0), (1, 3.0), (2, 5.0), (2, None), (3, 1.0), (3, 1.0), (3, 9.0)]
    got = {r.doc_id: (r.median_font, r.max_font) for r in scan.font_statistics(spark.createDataFrame(sizes, "doc_id long, font_size double")).collect()}
    assert got == {1: (3.0, 3.0), 2: (5.0, 5.0), 3: (1.0, 9.0)}
    native = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, " ")], "doc_id long, page int, text string")
    blocks = spark.createDataFrame([(1, 1)], "doc_id long, page int")
    assert [(r.page, r.text, r.source) for r in scan.fallback_lines(native, blocks).collect()] == [(2, "b", "digital_fallback")]


def test_tables(spark):
    rows = spark.createDataFrame([(1, 2, [["h", " x "], ["v", None, "w"]])], "table_id long, page int, rows array<array<string>>")
    got = sorted((r.row, r.col, r.text, r.is_header, r.row_count, r.col_count) for r in scan.table_cells(rows).collect())
    assert got == [(0, 0, "h", True, 2, 3), (0, 1, "x", True, 2, 3), (1, 0, "v", False, 2, 3), (1, 1, "", False, 2, 3), (1, 2, "w", False, 2, 3)]
    cells = spark.createDataFrame([(1, 4, 0, 1, 11), (1, 4, 0, 0, 10), (1, 4, 1, 0, 12)], "doc_id long, table_no int, row int, col int, pos int")
    lines = spark.createDataFrame([(1, 11, 3), (1, 12, 2)], "doc_id long, pos int, section int")
    edges = {(r.src, r.dst, r.relationship) for r in graph.table_edges(cells, lines).collect()}
    assert ("table:4", "sec:3", "TABLE_CONTEXT") in edges and len(edges) == 5


def test_a_phrase_of_three_words_counts_nine_tenths(spark):
    # No word of over two characters is shared; of eight words three are: 0.9 / 8 is 0.1125, which rounds to 113.
    row = spark.createDataFrame([("a bb cc dd ee ff gg hundred", "x a bb cc y")], "q string, l string")
    match = retrieval.text_match(retrieval.question_parts(F.col("q")), retrieval.line_parts(F.col("l")))
    assert row.select(F.floor(match * 1000 + 0.5).alias("m")).first().m == 113
