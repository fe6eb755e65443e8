import random
import re
from collections import Counter

from evidra.llm.quality import MAX_LABELLED, base_features, content_share, featured_lines, fit_field, judge, quality_filter, shared_lines, viterbi

WORD = r"[^\x20\x09-\x0D]+"


def base(text):
    words = re.findall(WORD, text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += bool(re.search(WORD, line)) and line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def prose(r, n):
    return " ".join(r.choice("the of and river house walks slowly green morning light over under many".split()) + r.choice(["", str(r.randint(0, 99999))]) for _ in range(n)).capitalize() + "."


def corpus():
    r = random.Random(1)
    good = [(i, "\n".join(prose(r, 30) for _ in range(4)), "s") for i in range(60)]
    bad = [(100 + i, "\n".join(" ".join(w.upper() + "!!" for w in prose(r, 25).split()) for _ in range(3)), "s") for i in range(40)]
    return good, bad


def test_base_features():
    r = random.Random(2)
    texts = [None, "", " \n", "a b c a b c", "x\nx\n\n\nx\ny\x0bz w", "#|<é>&&"] + ["".join(r.choice("ab \n\t#é") for _ in range(r.randint(0, 80))) for _ in range(300)]
    texts.append(" ".join(r.choice("abcdefghijklmnop") for _ in range(21_000)))
    for t in texts:
        assert base_features(t) == base(t)


def test_viterbi_is_the_best_path():
    import itertools

    r = random.Random(3)
    emit = [[r.uniform(-2, 2), r.uniform(-2, 2)] for _ in range(61)]
    move = [[r.uniform(-1, 1), r.uniform(-1, 1)] for _ in range(2)]
    for n in range(1, 8):
        lines = [r.sample(range(61), 11) for _ in range(n)]
        score = lambda p: sum(sum(emit[f][y] for f in x) for x, y in zip(lines, p, strict=True)) + sum(move[a][b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        assert abs(score(viterbi(lines, emit, move)) - max(map(score, itertools.product((0, 1), repeat=n)))) < 1e-9


def test_held_out_verdicts(spark, make_docs):
    good, bad = corpus()
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in good[:40]] + [(i, 0, 0) for i, *_ in bad[:25]] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    extra = [(500, None, "s"), (501, "", "s"), (502, "too short", "s"), (None, good[0][1], "s"), (503, "same three words " * 40, "s")]
    docs = make_docs(good + bad + extra)
    got = {r.doc_id: r for r in judge(docs, labels).collect()}
    assert all(got[i].kept for i, *_ in good) and not any(got[i].kept for i, *_ in bad)
    assert not any(got[i].kept for i in (500, 501, 502, 503)) and got[503].base_failed and got[None].kept
    kept = quality_filter(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, *_ in good} | {None}


def test_without_labels_the_base_rule_decides(spark, make_docs):
    good, bad = corpus()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept == (not r.base_failed) for r in judge(make_docs(good + bad), none).collect())
    assert judge(make_docs([]).limit(0), none).count() == 0
    assert fit_field([]).emit[0] == [0.0, 0.0] and featured_lines(None) == ([], [], [])


def mixed_corpus():
    """Good documents with shared lines, bad ones with shouted lines around prose."""
    r = random.Random(6)
    shared = [prose(r, 9) for _ in range(4)]
    shout = lambda n: " ".join(w.upper() + "!!" for w in prose(r, n).split())
    good = ["\n".join(r.sample([prose(r, 25) for _ in range(4)] + r.sample(shared, r.randint(0, 2)), k=4)) for _ in range(80)]
    bad = ["\n".join([shout(25) for _ in range(4)] + [prose(r, 20)]) for _ in range(50)]
    return good, bad, shared


def test_lines_of_one_document_get_both_labels():
    good, bad, shared = mixed_corpus()
    field = fit_field([(t, 1) for t in good[:60]] + [(t, 0) for t in bad[:40]])
    right = []
    for text in good[60:]:
        marked = viterbi(featured_lines(text, field.shared)[0], field.emit, field.move)
        right += [(y, x not in shared) for x, y in zip(text.split("\n"), marked, strict=True)]
    assert sum(y == want for y, want in right) >= 0.9 * len(right)
    assert {y for y, want in right if not want} == {0}
    for text in bad[40:]:
        features, sizes, _ = featured_lines(text, field.shared)
        assert content_share(viterbi(features, field.emit, field.move), sizes) < 0.5


def test_lines_of_copies_are_not_shared():
    good, _, shared = mixed_corpus()
    copies = [good[0]] * 50 + [good[1].replace("river", f"x{i}", 1) for i in range(5)]
    assert not shared_lines(copies)
    assert len(shared_lines(good)) == len(shared)


def test_verdicts_are_those_of_the_best_paths(spark, make_docs):
    import itertools

    good, bad, _ = mixed_corpus()
    rows = [(i, t, "s") for i, t in enumerate(good[:30] + bad[:20] + [None, "", "x", good[0] + "\n" + bad[0]])]
    labels = spark.createDataFrame([(i, int(i < 30), 0) for i in range(50)], "doc_id long, quality int, toxic int")
    docs = make_docs(rows)
    from evidra.llm.quality import fitted

    field = fitted(docs, labels, MAX_LABELLED)
    got = {r.doc_id: r for r in judge(docs, labels).collect()}
    for i, text, _ in rows:
        features, sizes, _ = featured_lines(text, field.shared)
        best = max(
            itertools.product((0, 1), repeat=len(features)),
            key=lambda p: sum(field.emit[f][y] for x, y in zip(features, p, strict=True) for f in x) + sum(field.move[a][b] for a, b in zip(p, p[1:], strict=False)),
        )
        share = sum(s for s, y in zip(sizes, best, strict=True) if y) / (sum(sizes) or 1)
        words, _, _, _, covered = base(text)
        failed = words < 50 or 100 * covered > 50 * words
        assert (got[i].base_failed, got[i].kept, got[i].n_content_lines) == (failed, not failed and share >= 0.5, sum(best))
    assert sum(got[i].kept for i in range(30)) >= 27 and not any(got[i].kept for i in range(30, 53))
