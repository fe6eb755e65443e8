import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidra.llm import token_counts as T

PARTS = "a b the r e s ! ... 1 23 é 中 文 的 😀 ' 's 're I'll don't ----- ==== <|endoftext|> <|end |> ́ ǅ".split(" ") + [" ", "  ", "\n", "\n\n", "\t", "　", "\xa0", " '", "\r\n", "\U0001e900"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(T.default_model())
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return T.PrefixCounter(*T.load())


def of_prefixes(counter, text):
    return np.cumsum(T.unzigzag(counter.differences(text))).tolist()


def test_every_prefix_of_random_texts(counter, library):
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 14)))
        assert of_prefixes(counter, text) == [library(text[:i]) for i in range(1, len(text) + 1)], text


def test_every_kind_of_character(counter, library):
    rng = random.Random(2)
    points = [chr(c) for c in rng.sample(range(0x110000), 4000) if not 0xD800 <= c < 0xE000]
    text = "".join(p + rng.choice(["", " ", "a", "1", "!", "\n"]) for p in points)
    assert of_prefixes(counter, text)[-1] == library(text)
    for i in range(0, len(text), 997):
        assert of_prefixes(counter, text)[i] == library(text[: i + 1])


def test_long_stretches(counter, library):
    for text in ("a" * 100_000, "ab" * 50_000, " " * 50_000 + "x", "中文字符" * 20_000, "\n" * 9999, "=-" * 30_000):
        counts = of_prefixes(counter, text)
        assert len(counts) == len(text)
        for i in (1, 2, 65, 1000, len(text) - 1, len(text)):
            assert counts[i - 1] == library(text[:i])


def test_few_kept(library):
    small = T.PrefixCounter(*T.load(), kept=3)
    text = "one two three four five six seven one two eight <|endoftext|> nine  ten's " * 20
    assert of_prefixes(small, text) == [library(text[:i]) for i in range(1, len(text) + 1)]
    small.forget()
    assert not small.young and not small.pairs


@pytest.mark.parametrize("values", [[], [0], [1, -1, 0, 63, -64], [64, -65, 1, 10**6, -(10**6), 0, 5], [2**40]])
def test_zigzag_round_trip(values):
    assert T.unzigzag(T.zigzag(np.array(values, np.int64))).tolist() == values


def test_table_and_its_answers(spark, make_docs, library):
    texts = [None, "", "Hello  world, it's <|endoftext|> here.\n\nNew line", "word " * 3000, "é中" * 500, "x"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(2, texts[2], "s"), (None, "no id", "s")]
    counted = T.written(T.prefix_table(make_docs(rows).selectExpr("*", "1 AS n_tokens", "2 AS prefixes")), "prefixes")
    got = {r[0]: r for r in T.answers(counted, 7).collect()}
    for i, t, _ in rows:
        t = t or ""
        longest = max(k for k in range(len(t) + 1) if k < 60 and library(t[:k]) <= 7) if library(t) > 7 else len(t)
        assert tuple(got[i]) == (i, len(t.encode()), library(t), library(t) > 7, longest)
    assert T.answers(counted).count() == len(rows)
    for n in (0, 3, 10, 10**6):
        for r in T.tokens_until(counted, F.lit(n)).collect():
            assert r["tokens"] == library((dict((i, t) for i, t, _ in rows)[r["doc_id"]] or "")[:n])
    assert [r["tokens"] for r in T.tokens_until(counted.limit(1), F.lit(None)).collect()] == [None]


def test_truncated_texts_fit(spark, make_docs, library):
    docs = make_docs([(1, "word " * 3000, "s"), (2, "short", "s"), (None, "none", "s"), (3, None, "s")])
    cut = T.truncated(docs, T.prefix_table(docs), 50)
    assert cut.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[2] == "short" and texts[None] == "none" and texts[3] is None
    assert library(texts[1]) <= 50 < library(texts[1] + "word w")


def test_packed_fills_the_budget(spark, make_docs, library):
    rng = random.Random(3)
    texts = {i: " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(0, 40))) for i in range(60)}
    counted = T.prefix_table(make_docs([(i, t, "s") for i, t in texts.items()]))
    rows = T.packed(counted, 500).collect()
    assert sum(r["taken"] for r in rows) == 500
    assert all(library(texts[r["doc_id"]][: r["kept_chars"]]) == r["taken"] for r in rows)
    assert sum(r["taken"] < r["n_tokens"] for r in rows) <= 1
    assert sum(r["taken"] for r in T.packed(counted, 10**9).collect()) == sum(map(library, texts.values()))


def test_empty_table(spark, make_docs):
    assert T.answers(T.prefix_table(make_docs([]))).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit", "kept_chars"]
    assert T.answers(T.prefix_table(make_docs([]))).count() == 0


def test_other_models_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        T.PrefixCounter('{"model": {"type": "WordPiece"}, "pre_tokenizer": {"type": "ByteLevel"}, "normalizer": null, "added_tokens": []}', {"L": "a", "N": "1", "S": " "})
