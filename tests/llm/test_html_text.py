import os
import random
import time
from html.parser import HTMLParser

import pytest

from evidra.llm.html_text import AROUND, extract, main_text

LONG = "This paragraph of the article goes on for quite some time so that it stands out among the lines of the page."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<article><h1>T &amp; U</h1><p>One<br>two <i>th</i>ree.<p>Of.</article>", "T & U One two three. Of."),
        (f"<nav><a>x</a></nav><div class='ad'>buy</div><article><p>{LONG}</p></article><footer>&copy;</footer>", LONG),
        (f"<body><div id=menu><a>a</a></div><h2>Head</h2><p>{LONG}<p>Short.<p>{LONG}<div class='comments'><p>{LONG}</div></body>", f"Head {LONG} Short. {LONG}"),
        (f"<article><p>{LONG}</p><aside>side</aside><form><p>name</form><p>End</p><section class=comment-list>{LONG}</section></article>", f"{LONG} End"),
        ("<article><p>a<script>var t = '</p>';</script>b</p></article>", "a b"),
        ('<article><p title="x > y">kept</p><!-- <p>gone</p> --></article>', "kept"),
        ("<article><header><h1>Title</h1></header><p>x</p><footer>foot</footer></article>", "Title x"),
        ("<p>only a short page", "only a short page"),
        ("<article><p>unclosed <script>var x", "unclosed"),
        ("a < b and c", "a < b and c"),
        (f"<div class='page has-sidebar'><p>{LONG}</p></div><div class=cookieNotice>we use</div>", LONG),
        (f"<div class='site-header'>Site</div><div class='post-header'><h1>Head of it</h1></div><p>{LONG}</p>", f"Head of it {LONG}"),
        ("<article><p>&lt;p&gt; &#233; &nbsp; &hellip;</article>", "<p> é …"),
    ],
)
def test_main_text(html, text):
    assert main_text(html) == text


BROKEN = ['<a "x ', "<a ", '<a b="', '<a ="', "<!-", "<script ", "<div>", "<b>", "<li>", "<p><b>x", "&a", "<a class = ", "<a b='\" "]
#: Ends of elements with raw content that aren't ends, for they are never closed themselves.
FALSE_ENDS = ["</script ", "</style ", "</textarea ", "</title\t", "</scriptx>"]


def seconds(html):
    began = time.process_time()
    assert main_text(html) is not None
    return time.process_time() - began


@pytest.mark.parametrize("piece", BROKEN)
def test_broken_markup_stays_linear(piece):
    """Four times the page takes about four times the time; a square would be sixteen."""
    for page in (lambda n: "<article>" + piece * n, lambda n: piece * n + "</p>" * n + ">"):
        assert seconds(page(200_000)) < 9 * min(seconds(page(50_000)) for _ in range(2)) + 0.5


@pytest.mark.parametrize("piece", FALSE_ENDS)
def test_false_ends_of_raw_elements_stay_linear(piece):
    name = piece[2:].strip("x> \t")
    for page in (lambda n: f"<{name}>" + piece * n, lambda n: f"<{name}>x</{name}><p>seen</p>" * (n // 8) + f"<{name}>" + piece * n):
        assert seconds(page(200_000)) < 9 * min(seconds(page(50_000)) for _ in range(2)) + 0.5
    assert main_text(f"<article>a<{name}></{name} x><p>b") == "a b"


def test_windows_lift_short_lines():
    """A short line of an article is below 0 by itself; windows with its neighbours keep it, and long text outweighs marks."""
    from evidra.llm.html_text import PENALTY, Line, line_weights, text_lines

    article = [Line(t, 0, True, False, False) for t in (LONG, "So", LONG)]
    assert line_weights(article)[1] < 0 and text_lines(article) == [0, 1, 2]
    plain = [Line(LONG, 0, False, False, False), Line("x", 1, False, False, False), Line(LONG, 0, False, False, False)]
    assert line_weights(plain)[1] < 0 and text_lines(plain) == [0, 1, 2]
    marked = [Line("w" * n, 0, False, True, False) for n in (60, 64 * PENALTY + 800)]
    assert text_lines(marked) == [1]


def test_long_pages_are_whole():
    assert len(main_text("<article>" + "<p>word</p>" * 50_000 + "</article>")) == 50_000 * 5 - 1
    assert len(main_text("<article><p>" + "w " * 2_000_000)) == 4_000_000 - 1


MENU = "".join(f"<li><a href=/{i}>Entry {i}</a></li>" for i in range(5))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<article><ul>{MENU}</ul><h1><a>Head</a></h1><p>{LONG}</p><ul>{MENU}</ul></article>", f"Head {LONG}"),
        (f"<article><p><a>Up</a></p><p>{LONG}</p><p><a>Source</a></p></article>", f"Up {LONG} Source"),
        (f"<article><p>{LONG}</p><div class=ad>{LONG}</div><p>End</p></article>", f"{LONG} End"),
        (f"<div>{MENU}</div><p>{LONG}</p><ul>{MENU}</ul><p>{LONG}</p><ul>{MENU}</ul>", f"{LONG} {LONG}"),
        (f"<p>{LONG}</p>" + "<p>x</p>" * 9 + f"<p>{LONG}</p>" + "<p>y</p>" * 9, " ".join([LONG, *"x" * 9, LONG, "y", "y"])),
        (f"<form id=aspnet><p>{LONG * 8}</p><label>Name</label></form>", LONG * 8),
        (f"<div>We use things.</div><article><p>{LONG}</p></article><div>Made by us.</div>", LONG),
    ],
)
def test_windows_decide(html, text):
    assert main_text(html) == text


class Walk(HTMLParser):
    """Lines of well-formed pages with the elements around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path, self.lines, self.parts = [], [], []

    def cut(self):
        text = " ".join("".join(p for p, _ in self.parts).split())
        if text and not any(n in ("head", "script", "style") for n, _ in self.path):
            plain = " ".join("".join(p for p, a in self.parts if not a).split())
            self.lines.append((text, len(text) - len(plain), list(self.path)))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag not in ("a", "b"):
            self.cut()
        if tag not in ("meta", "br"):
            self.path.append((tag, " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))))

    def handle_endtag(self, tag):
        if tag not in ("a", "b"):
            self.cut()
        self.path.pop()

    def handle_data(self, data):
        names = [n for n, _ in self.path]
        self.parts.append((data, "a" in names and "h1" not in names))


def walked(html):
    """The text of a page by the definition, window by window."""
    walk = Walk()
    walk.feed(html)
    walk.cut()
    rows = []
    for text, linked, path in walk.lines:
        names = [n for n, _ in path]
        around = not {"nav", "footer", "aside"}.isdisjoint(names) or any(set(c.split()) & AROUND for _, c in path)
        rows.append((text, len(text) - 2 * linked, around, "form" in names, "article" in names))
    named = any(article and not around for *_, around, _, article in rows)
    weights = [
        n / 16 - 320 if around else n / 4 - 100 if form else n - 4 if article else n / 8 - 160 if named else n
        for _, n, around, form, article in rows
    ]
    n = len(rows)
    hard = {i for i in range(n) if weights[i] <= -80}

    def windows(i):
        for k in (1, 2, 3):
            if i + k <= n and hard.isdisjoint(range(i, i + k)):
                yield sum(weights[i : i + k])

    surge = [weights[i] > 0 and max(windows(i), default=-1) >= 30 for i in range(n)]
    dive = [i in hard or max(windows(i)) <= 0 for i in range(n)]
    kept = set()
    for i in range(n):
        before = next((j for j in range(i, -1, -1) if surge[j] or dive[j]), None)
        if before is None or not surge[before]:
            continue
        after = next((j for j in range(i + 1, n) if surge[j] or dive[j]), None)
        if after is not None and surge[after] or i < before + 3:
            kept.add(i)
    for i in range(n):  # short runs of article lines between text and a break
        if i in kept or i in hard:
            continue
        low = next((j for j in range(i, -1, -1) if j in hard), -1)
        high = next((j for j in range(i, n) if j in hard), n)
        inside = [j for j in range(low + 1, high) if j in kept]
        if inside and (i < inside[0] and inside[0] - low <= 3 and all(rows[j][4] for j in range(low + 1, inside[0]))
                       or i > inside[-1] and high - inside[-1] <= 3 and all(rows[j][4] for j in range(inside[-1] + 1, high))):
            rows[i] = (*rows[i][:5], True)
    found = [i for i in range(n) if i in kept or len(rows[i]) > 5]
    own = {i for i in range(n) if rows[i][4] and rows[i][1] >= 0 and not rows[i][2] and not rows[i][3] and weights[i] > -80}
    return " ".join(rows[i][0] for i in sorted(own | set(found or [i for i in range(n) if weights[i] > 0])))


def random_page(r):
    def block(depth):
        kind = r.random()
        words = " ".join(r.choice(("of", "river", "A&amp;B", "walks")) for _ in range(r.choice([1, 2, 5, 30])))
        if kind < 0.4 or depth > 4:
            return f"<p>{words}</p>"
        if kind < 0.6:
            return f"<p><a>{words}</a>{r.choice(['', ' more'])}</p>"
        if kind < 0.7:
            return f"<h1>{r.choice(['', '<a>'])}Head{words}</h1>".replace("<a>Head", "<a>Head</a> ")
        name = r.choice(["div", "div class=ad", "section", "article", "nav", "aside", "form", "div id=x"])
        return f"<{name}>" + "".join(block(depth + 1) for _ in range(r.randint(1, 6))) + f"</{name.split()[0]}>"

    return "<html><head><title>t</title><style>p{}</style></head><body>" + "".join(block(0) for _ in range(r.randint(1, 12))) + "</body></html>"


def test_equals_a_walk_over_the_tree():
    r = random.Random(4)
    for _ in range(3000):
        html = random_page(r)
        assert main_text(html) == walked(html), html


def test_equals_the_walk_on_given_pages(spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    for html, text in extract(spark.read.parquet(path)).join(spark.read.parquet(path).select("page_id", "html"), "page_id").select("html", "text").collect():
        assert text == walked(html.replace("<p><b>", "<p>").replace("<br>", "</p>"))


def test_rows(spark):
    rows = [(1, "u", "<article>x</article>"), (1, "u", "<article>x</article>"), (2, None, None), (None, "v", "<p>é</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'q' AS text", "3 AS n_chars")
    got = extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", "x", 1), (1, "u", "x", 1), (2, None, "", 0), (None, "v", "é", 1)], key=str)
    assert extract(pages.limit(0)).count() == 0
