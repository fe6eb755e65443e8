"""Claims that are paired in their document's row: the same as by joins, whatever the sizes of documents, without an exchange."""

import pytest
from pyspark.sql import functions as F

from evidra.operators import claims, graph, retrieval
from evidra.plans import evidence

CLAIM = "doc_id long, section long, pos long, claim_type string, value string, claim_no int"
DATA = "/root/testdata/sf0.001"


def made(doc, orders):
    kinds = lambda i: [
        ("entity_date", f"2020-01-{i % 9 + 1:02d}"), ("entity_date", "2020-01-01"), ("fact_definition", f"Order {i % 4} = a Purchase"), ("fact_definition", " = nothing"),
        ("fact_specification", f"see order {i % 5}: {i}"), ("entity_contact", "me@x.org"),
    ]
    every = [(doc, i, 10 * i + j // 2, kind, value) for i in range(orders) for j, (kind, value) in enumerate(kinds(i))]
    return [(*row, n + 1) for n, row in enumerate(every)]


@pytest.fixture(params=[512, 20])  # with 20 the larger document's claims are joined
def both(spark, tmp_path, monkeypatch, request):
    monkeypatch.setattr(claims, "FEW", request.param)
    flat = spark.createDataFrame(made(1, 2) + made(2, 12), CLAIM)
    claims.packed(flat).write.parquet(str(tmp_path / "packed"))
    return flat, spark.read.parquet(str(tmp_path / "packed"))


def same(a, b):
    rows = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()))
    assert rows(a) == rows(b) != []


def test_rows_hold_all_claims(both):
    flat, packed = both
    same(flat.select("doc_id", "claim_no", "section", "pos", "claim_type", "value"), packed.select("doc_id", F.inline("claims")))


def test_pairs_are_those_of_joins(both):
    flat, packed = both
    same(claims.linked(flat), claims.packed_linked(packed))
    same(graph.collapse_edges(claims.claim_edges(flat), "doc_id", "a_claim_no", "b_claim_no"), claims.packed_edges(packed))
    same(claims.depends(flat), claims.packed_depends(packed))


def test_links_lead_where_edges_do(both):
    flat, packed = both
    hits = flat.where("claim_type = 'fact_specification'").selectExpr("0L AS query_id", "doc_id", "pos", "pos / 200 AS score")
    edges = claims.supports(flat).unionByName(claims.linked(flat))
    same(retrieval.claim_backlinks(hits, flat, edges), retrieval.along_links(hits, claims.packed_links(packed)))


@pytest.mark.parametrize("query", ["claim_linked", "claim_edges", "claim_depends"])
def test_pairs_move_no_claims(spark, query):
    plan = getattr(evidence, query)(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
