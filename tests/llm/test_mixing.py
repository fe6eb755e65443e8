import re
from collections import defaultdict

import pytest

from evidra.llm.mixing import mix, mix_documents


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """Shares by weight, capped at three times a source, the excess shared again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            return {s: 3 * sizes[s] if s in capped else share[s] for s in names}
        capped |= above


ROWS = [(i, "w " * (i * 7 % 23), ["b", "a", None, "c", "ä", "Z"][i % 6] if i < 60 else "huge") for i in range(300)] + [(900, None, "a"), (None, "x y", "b"), (901, "", "lonely"), (902, "one", "tiny")]


def test_targets_and_budgets(make_docs):
    rows = mix(make_docs(ROWS)).collect()
    sizes = defaultdict(int)
    for _, text, source in ROWS:
        sizes[source] += words(text)
    want = targets(sizes)
    taken = defaultdict(int)
    assert len(rows) == len(ROWS)
    for r in rows:
        taken[r._ev_source] += r._ev_taken
        assert 0 <= r._ev_taken <= 3 * r._ev_size
        assert r._ev_source_size == sizes[r._ev_source]
        assert r._ev_target == pytest.approx(want[r._ev_source])
    for source, t in want.items():
        assert taken[source] == int(t + 1e-9) or sizes[source] == 0


def test_reruns_agree(make_docs):
    a, b = ({(r._ev_doc, r._ev_row, r._ev_taken) for r in mix(make_docs(rows)).collect()} for rows in (ROWS, ROWS[::-1]))
    assert a == b


def test_documents_are_repeated(make_docs):
    docs = make_docs(ROWS)
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns
    counts = defaultdict(int)
    for r in mixed.collect():
        counts[r.doc_id] += 1
    for r in mix(docs).collect():
        if r._ev_doc is not None:
            assert counts[r._ev_doc] == (-(-r._ev_taken // r._ev_size) if r._ev_size else 0)


def test_empty(make_docs):
    assert mix(make_docs([]).limit(0)).count() == 0
    assert [r._ev_taken for r in mix(make_docs([(1, None, None)])).collect()] == [0]
