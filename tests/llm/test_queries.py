"""The registered queries on the smallest tables: columns, whole tables, and their oracles where SQL can express them."""

import math
import os

import duckdb
import pytest

from evidra.llm import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")

COLUMNS = {
    "op1_minhash": ("documents", ["doc_id", "class_id"]),
    "op2_mixing": ("documents", ["doc_id", "size", "source_size", "target", "taken"]),
    "op3_topk": (None, ["query_id", "rank", "vec_id", "score"]),
    "op4_line_dedup": ("documents", ["doc_id", "n_lines", "n_dropped", "kept_sha256"]),
    "op5_quality": ("documents", ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]),
    "op6_pieces": ("documents", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]),
    "op7_toxicity": ("documents", ["doc_id", "held_out", "score", "predicted"]),
    "op8_html_text": ("pages", ["page_id", "url", "text", "n_chars"]),
    "op9_lm_score": ("documents", ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]),
    "op10_warc": ("pages", ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]),
    "op11_token_counts": ("documents", ["doc_id", "n_bytes", "n_tokens", "over_limit"]),
    "op12_negatives": (None, ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]),
    "op13_resampling": ("documents", ["doc_id", "n_features", "weight", "score", "rank"]),
}


def plain(value):
    return (None if math.isnan(value) else round(value, 6)) if isinstance(value, float) else value


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    source, columns = COLUMNS[name]
    found = registry.queries()[name](spark, DATA)
    assert found.columns[: len(columns)] == columns
    rows = found.collect()
    if source:
        assert len(rows) == spark.read.parquet(f"{DATA}/{source}.parquet").count()
    if name in registry.oracle_sql():
        connection = duckdb.connect()
        for table in ("documents", "pages", "embeddings", "benchmark"):
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
        cursor = connection.execute(registry.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(found.columns)
        want = sorted((tuple(plain(v) for v in r) for r in cursor.fetchall()), key=str)
        assert sorted((tuple(plain(r[n]) for n in names) for r in rows), key=str) == want


def test_every_operator_is_registered():
    assert list(registry.queries()) == list(COLUMNS)
