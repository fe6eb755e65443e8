import hashlib
import random

import pytest
import sentencepiece

from evidra.llm import pieces

TEXTS = ["", " ", "a", "  two  spaces ", "line\nend\n\n", "tab\tand\x00zero", "日本語 and 😀 Ω≈", "▁ literal ▁▁", "<0x0A> <s> </s> <unk>", "ab" * 3000, "a" * 5001, "été".upper() * 20, "x" * 70 + "," * 70]


@pytest.fixture(scope="module")
def model():
    with open(pieces.default_model(), "rb") as f:
        return f.read()


def test_encoding_equals_the_library(model):
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.PieceCodec(model, kept=50)
    r = random.Random(1)
    parts = [*" ab  ethß▁\n\té日本😀\xa0.,'#", "the", "ing", "  ", *[p.replace("▁", " ") for p in list(codec.ids)[::37]]]
    texts = TEXTS + ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(2000)]
    for text in texts:
        ids, printed = codec.encode_printed(text)
        assert ids == library.encode(text), text
        assert printed == ",".join(map(str, ids)) and codec.decode(ids) == library.decode(ids)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (printed, library.decode(ids))]
        assert codec.digests(text) == (len(ids), *digests)


def test_long_stretches_take_little_memory(model):
    import tracemalloc

    library, codec, r = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.PieceCodec(model, kept=1000), random.Random(3)
    text = "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(300_000))
    want = library.encode(text)
    tracemalloc.start()
    got = codec.digests(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    printed = ",".join(map(str, want))
    assert got == (len(want), hashlib.sha256(printed.encode()).hexdigest(), hashlib.sha256(library.decode(want).encode()).hexdigest())
    assert peak < 30 * len(text)  # bytes a character


def test_backtracking_equals_merging(model):
    codec, r = pieces.PieceCodec(model), random.Random(2)
    for _ in range(1500):
        word = "▁" + "".join(r.choice("abcdeinrst") for _ in range(r.randint(1, 12)))
        assert codec.tokens(word) == codec.merged(word)


def test_digests_and_round_trip(spark, make_docs, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = list(enumerate(TEXTS)) + [(50, None), (51, "twice"), (51, "twice")]
    docs = make_docs([(i, t, "s") for i, t in rows])
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))))
    assert sorted(tuple(r) for r in pieces.encode_digests(docs).collect()) == sorted(want)
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs)).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in rows if i != 7)
    assert pieces.encode_digests(make_docs([]).limit(0)).count() == 0
