"""Joins of claims are merged: their size is only known once rows are exploded, so none may be broadcast on an estimate."""

import pytest

from evidra.operators import claims, retrieval

CLAIM = "doc_id long, section long, pos long, claim_type string, value string, claim_no int"
ROWS = [(1, 1, 10, "fact_definition", "Order 7 = a purchase", 1), (1, 1, 10, "fact_specification", "order 7: Order 7 = a purchase", 2), (1, 2, 20, "entity_date", "2020-01-01", 3)]


@pytest.fixture()
def found(spark, tmp_path):
    spark.createDataFrame(ROWS, CLAIM).write.parquet(str(tmp_path / "claims"))
    return spark.read.parquet(str(tmp_path / "claims"))  # so small that any side would be broadcast by its estimate


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("made", [claims.supports, claims.contradictions, claims.linked, claims.depends, claims.section_evidence, claims.claim_edges])
def test_pairs_of_claims_are_not_broadcast(found, made):
    assert "BroadcastHashJoin" not in _plan(made(found))


def test_backlinks_and_digests_are_not_broadcast(spark, found):
    hits = found.selectExpr("0L AS query_id", "doc_id", "pos", "0.5D AS score")
    edges = claims.supports(found).unionByName(claims.linked(found))
    assert "BroadcastHashJoin" not in _plan(retrieval.claim_backlinks(hits, found, edges))
    asked = spark.createDataFrame([(1, "who placed Order 7")], "query_id long, text string")
    assert "BroadcastHashJoin" not in _plan(retrieval.evidence_summary_hits(claims.section_evidence(found), found, asked))
