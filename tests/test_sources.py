import json

import pytest
from pyspark.sql import functions as F

from evidra.functions import seams
from evidra.operators import graph
from evidra.sources import files, views
from evidra.streaming import ingest


def test_ingest_files(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"x")
    row = files.ingest_files(spark, str(tmp_path), "*.PDF").first()
    assert row.checksum == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert (row.filename, row.extension, bytes(row.content)) == ("a.PDF", ".pdf", b"abc") and row.checksum.startswith(row.doc_id)


def test_graph_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "SECTION 1\nfirst line, here: 1."), (2, "other, text; 2.")], "doc_id int, text string")
    lines = views.sectioned(views.lines(docs))
    edges = graph.collapse_edges(graph.structure_edges(lines), "doc_id", "src", "dst")
    nodes = lines.select("doc_id", F.concat(F.lit("line:"), F.col("pos").cast("string")).alias("id"), "text")
    path = str(tmp_path / "g")
    files.save_graph(nodes, edges, path)
    n, e = files.load_graph(spark, path, 1)
    assert n.count() == 2 and {r.relationship for r in e.collect()} == {"BELONGS_TO", "SECTION_SUMMARY_OF", "NEXT_LINE"}
    export = json.loads(files.node_link_json(n, e).first().graph)
    assert len(export["nodes"]) == 2 and export["directed"]
    assert sorted(r.doc_id for r in files.documents_in(spark, path).collect()) == [1, 2]
    files.delete_document(spark, path, 1)
    assert [r.doc_id for r in files.documents_in(spark, path).collect()] == [2]


def test_vector_store(spark, tmp_path):
    path, made = str(tmp_path / "v"), lambda rows: spark.createDataFrame(rows, "doc_id int, node string, v array<float>")
    files.save_vectors(made([(1, "a", [1.0, 0.0]), (2, "b", [0.0, 1.0])]), path, 2)
    files.save_vectors(made([(1, "c", [0.5, 0.5, 0.0])]), path, 3)
    got = {r.node: (r.doc_id, list(r.v), r.reindex) for r in files.load_vectors(spark, path, 2).collect()}
    assert got == {"b": (2, [0.0, 1.0], False), "c": (1, [0.5, 0.5, 0.0], True)}
    assert files.load_vectors(spark, path, doc_id=2).count() == 1
    with pytest.raises(Exception, match="components"):
        files.save_vectors(made([(3, "d", [1.0])]), path, 2)


def test_metadata_and_pictures(spark, tmp_path):
    meta, pics = str(tmp_path / "m"), str(tmp_path / "p")
    for rows in ([(1, "one", None), (2, "two\nlines", 2.5)], [(1, "anew", 1.0)]):
        files.save_metadata(spark.createDataFrame(rows, "doc_id int, title string, mb double"), meta)
    got = sorted((r.doc_id, r.title, r.mb) for r in files.load_metadata(spark, meta, "title string, mb double, doc_id int").collect())
    assert got == [(1, "anew", 1.0), (2, "two\nlines", 2.5)]
    files.save_pictures(spark.createDataFrame([(1, "img_a_p0_0", "png", b"\x89P"), (2, "x", "jpeg", None)], "doc_id int, image_id string, format string, content binary"), pics)
    row = files.load_pictures(spark, pics, 1).first()
    assert (row.filename, bytes(row.content)) == ("img_a_p0_0.png", b"\x89P") and files.load_pictures(spark, pics).count() == 2


def test_seams(spark):
    row = spark.createDataFrame([("t", None)], "t string, s string").select(seams.encoder_text("query", F.col("t")).alias("q"), seams.encoder_text("passage", F.col("t"), F.lit("S")).alias("p"), seams.encoder_text("table", F.col("t"), F.col("s")).alias("n")).first()
    assert row.q == "Represent this query for retrieving relevant document content: t"
    assert row.p == "Represent this document passage for retrieval: Section: S. t" and row.n == "Represent this table for retrieval: t"
    row = spark.createDataFrame([("a b a",)], "t string").select(seams.hashed_words(F.col("t")).alias("v")).first()
    assert len(row.v) == seams.DIMENSION and abs(sum(x * x for x in row.v) - 1) < 1e-6


def test_streaming_ingest(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, "one\ntwo"), (2, "one\ntwo"), (3, "three")]
    spark.createDataFrame(rows, "doc_id int, text string").coalesce(1).write.parquet(source)
    stream = ingest.new_documents(spark, source, "doc_id int, text string")
    ingest.run(stream, views.lines, out, str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(out).count() == 3
