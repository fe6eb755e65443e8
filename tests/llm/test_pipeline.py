import hashlib
import random

import pytest
import sentencepiece

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from evidra.llm import pieces  # noqa: E402

SHARED = "One line that a great many of the documents in this small corpus have in common."


def prose(r, n):
    return " ".join(r.choice("the of and river house walks slowly green morning light over under many".split()) + str(r.randint(0, 9999)) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean documents with a shared line, near copies, junk and empty texts, and labels for some."""
    r = random.Random(9)
    rows = []
    for i in range(60):
        rows.append((i, "\n".join([prose(r, 40), prose(r, 40), prose(r, 40), SHARED]), "en", f"s{i % 4}"))
    for i in range(10):
        rows.append((100 + i, rows[i][1].replace(SHARED, "").strip() + f" end{i}", "en", "s0"))
    for i in range(30):
        rows.append((200 + i, "\n".join(" ".join(w.upper() + "!!" for w in prose(r, 30).split()) for _ in range(3)), "en", "s1"))
    rows += [(300, None, "en", None), (301, "", None, "s2"), (302, "too few words", "en", "s3")]
    where = str(tmp_path_factory.mktemp("data"))
    spark.createDataFrame([(*row, len(row[1] or "")) for row in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 60, 2)] + [(200 + i, 0, 0) for i in range(0, 30, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, rows


def test_stages(spark, folder):
    where, rows = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, where), f"test-{name}")
        seen[name] = docs.collect()
        if name != "encoding":
            assert docs.columns == columns
    assert {r.doc_id for r in seen["quality_rules"]} == {i for i, *_ in rows if i < 200}
    texts = {r.doc_id: r.text for r in seen["line_dedup"]}
    assert [i for i in texts if SHARED in texts[i]] == [59]
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"])
    assert {r.doc_id for r in seen["near_dedup"]} == set(range(60))
    sizes = {}
    for r in seen["near_dedup"]:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    mixed = {}
    for r in seen["mixing"]:
        mixed[r.source] = mixed.get(r.source, 0) + len(r.text.split())
    weight, largest = {"s0": 1, "s1": 2, "s2": 3, "s3": 1}, max(len(t.split()) for t in texts.values())
    for s, n in mixed.items():
        assert abs(n - sum(sizes.values()) * weight[s] / 7) <= largest
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    digest = lambda i: hashlib.sha256(",".join(map(str, library.encode(texts[i]))).encode()).hexdigest()
    assert sorted((r.doc_id, r.ids_sha256) for r in seen["encoding"]) == sorted((r.doc_id, digest(r.doc_id)) for r in seen["mixing"])


def test_run_is_its_stages(spark, folder):
    where, _ = folder
    got = corpus_pipeline.run(spark, where)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 0


def test_empty_documents(spark, folder, tmp_path):
    where, _ = folder
    spark.read.parquet(f"{where}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{where}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
