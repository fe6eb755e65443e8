import hashlib
from collections import defaultdict

from evidra.llm.line_dedup import apply_bitmaps, dedup_lines, keep_bitmaps

WHITE = " \t\x0b\x0c\r\n"
SHARED = "A line that very many documents of this corpus share, word for word."


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(rows):
    held = defaultdict(set)
    for i, text, _ in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 40:
                held[key(line)].add(i)
    out = []
    for i, text, _ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(key(x), ())) < 5 or i == max(held[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def check(docs, rows):
    done = apply_bitmaps(docs, keep_bitmaps(docs)).collect()
    got = [(r.doc_id, r._ev_lines, r._ev_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in done]
    assert sorted(got, key=str) == brute(rows)


def test_shared_lines_stay_in_the_largest_document(make_docs):
    rows = [(i, f"own line of {i}\n  {SHARED.upper() if i % 2 else SHARED}\t\n" + SHARED * (i == 3), "s") for i in range(9)]
    check(make_docs(rows), rows)


def test_nulls_empty_short_and_long(make_docs):
    many = "\n".join(f"{SHARED} {i % 3}" for i in range(500))
    rows = [(1, None, "s"), (2, "", "s"), (3, "\n\n", None), (None, SHARED, "s"), (4, "é" * 39, "s")] + [(10 + i, many + f"\n{i}", "s") for i in range(6)]
    check(make_docs(rows), rows)


def test_non_ascii_keys_keep_their_case(make_docs):
    upper, lower = "ÉCOLE " + SHARED, "école " + SHARED
    rows = [(i, upper if i < 3 else lower, "s") for i in range(6)]
    check(make_docs(rows), rows)


def test_columns_pass_through_and_empty_table(make_docs):
    docs = make_docs([(1, "a", "s")])
    assert dedup_lines(docs).columns == docs.columns
    assert dedup_lines(make_docs([]).limit(0)).count() == 0


def test_repeated_rows(make_docs):
    rows = [(1, SHARED, "s"), (1, SHARED, "s"), (1, SHARED + "\nother", "s")] + [(i, SHARED, "s") for i in range(2, 7)]
    check(make_docs(rows), rows)
