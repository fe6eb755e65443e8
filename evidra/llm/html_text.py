"""Main text of HTML pages by line-block distribution.

Markup is stripped in one pass: a page becomes a sequence of lines, one per block, with character references decoded
and white space collapsed. Every line gets a weight from its length and the evidence around it:

* plain characters count for a line, characters in links against it (twice, so that a line of links is below 0; links
  inside headings count as plain);
* a line inside ``article`` or ``main`` costs ``COST`` and gets ``BONUS`` back, which is less than a surge takes: a short
  one is below 0 and stays only where its neighbours lift it;
* on a page that names its article, an eighth of other lines' characters counts, less twice the penalty;
* lines in what surrounds an article (by element, or by the words of class, id and role) count a sixteenth of their
  characters, less four times the penalty; those in forms a quarter, less a penalty and a quarter. Long text outweighs
  these.

Weights are summed over windows of up to ``WINDOW`` lines. A line whose own weight is ``-PENALTY`` or less breaks the
page. Between breaks the text surges at a line above 0 from which some window reaches the threshold. It dives where
all windows are at 0 or below; between two surges without such a point it goes on, after the last one it lasts for the
rest of the window. Fewer than a window of article lines between a surge or dive and a break stay. Lines between surge and
dive are the text. If no line of a page surges, all lines above 0 are. Nothing of an article is dropped for being short:
its own lines that no window lifts (cells of a table, say), unless mostly links, stay too.

Defined cases: a null or empty html gives an empty text; unclosed elements end with their parent or the page; an
unclosed comment, script or tag runs to the page's end; a quote that is never closed is an ordinary character; rows
that repeat a page_id are each extracted; extra columns are ignored; an empty table gives an empty table. Time is
linear in the page, broken markup included.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from evidra.llm.common import map_rows, table

WINDOW, THRESHOLD = 3, 30
COST, BONUS = 30, 26  # what an article's line costs, and what it gets for being one: less than a surge takes
PENALTY = 80
#: Elements whose content isn't markup.
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of the page: their content is dropped with the markup.
UNSEEN = frozenset("head template noscript button select option svg canvas object audio video map math".split())
#: Elements that surround an article.
OUTSIDE = frozenset("nav footer aside menu dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open one of the same name.
SIBLINGS = frozenset("li td th tr dt dd".split())
#: Words of class, id and role that mark what surrounds an article.
AROUND = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist contentinfo cookie cookies copyright "
    "dialog disqus footer footnav form gdpr login masthead menu menus modal nav navbar navigation navigational newsletter notice notices notification pagination pager "
    "popup promo promoted promotion related replies reply respond search share sharing sidebar sidebars signup social sponsor sponsored subscribe toolbar topbar widget widgets "
    "complementary alert consent disclaimer legal adsbygoogle adbox adslot adunit responses crumbs popover".split()
)
#: Words that make a header one of the article and not of the site.
TITLE = frozenset("article content entry main post story text title".split())
#: Attributes up to the tag's end; a quote holds what is between it and the next one, if there is one.
_ATTRIBUTES = re.compile(r"""(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_MARKS = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_PARTS = re.compile(r"[^a-z]+")
_BESIDE = re.compile(r"\b(?:has|with|no|without)[-_ ]\w+")
_HIDDEN = re.compile(r"\bhidden\b|aria-hidden\s*+=\s*+[\"']?true|display\s*+:\s*+none", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class Line(NamedTuple):
    """A line of a page, and the evidence about it."""

    text: str
    linked: int  # characters in links outside headings
    article: bool
    around: bool
    form: bool


class _Open(NamedTuple):
    name: str
    unseen: bool
    article: bool
    around: bool
    form: bool


_TOP = _Open("", False, False, False, False)


def _is_around(attributes: str, article: bool) -> bool:
    for found in _MARKS.finditer(attributes):
        value = found[1] or found[2] or found[3] or ""
        plain = _BESIDE.sub(" ", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())
        parts = _PARTS.split(plain)
        if not AROUND.isdisjoint(parts) or not article and "header" in parts and not TITLE.intersection(parts):
            return True
    return bool(_HIDDEN.search(attributes))


def _tokens(html: str):
    """Pieces of a page: (text, None, None, None) or (None, closing?, name, attributes). Every character is looked at
    a bounded number of times: whatever isn't closed ends the scan."""
    at, n = 0, len(html)
    while at < n:
        start = html.find("<", at)
        if start < 0:
            yield html[at:], None, None, None
            return
        if start > at:
            yield html[at:start], None, None, None
        after = html[start + 1 : start + 2]
        closing = after == "/"
        if after in ("!", "?") and after or closing and not html[start + 2 : start + 3].isalpha():
            comment = html.startswith("<!--", start)
            end = html.find("-->" if comment else ">", start + (4 if comment else 2))
            if end < 0:
                return
            at = end + (3 if comment else 1)
            continue
        name = _NAME.match(html, start + 1 + closing)
        if name is None:
            yield "<", None, None, None
            at = start + 1
            continue
        end = _ATTRIBUTES.match(html, name.end()).end()
        if end >= n:
            return  # a tag without an end
        tag, attributes = name[0].lower(), html[name.end() : end]
        yield None, closing, tag, attributes
        at = end + 1
        if tag in RAW and not closing and not attributes.endswith("/"):
            close = _RAW_END[tag].search(html, at)
            end = -1 if close is None else html.find(">", close.end())
            if end < 0:
                return  # no later close can end either
            at = end + 1


def _collapsed(parts: list[str]) -> str:
    joined = "".join(parts)
    return " ".join((unescape(joined) if "&" in joined else joined).split())


def page_lines(html: str) -> list[Line]:
    """The lines of a page in order."""
    lines: list[Line] = []
    parts: list[str] = []
    plain: list[str] = []  # the parts outside links
    stack: list[_Open] = []
    count: Counter = Counter()  # open elements by name
    links = headings = 0
    now = _TOP

    def flush() -> None:
        if parts and not now.unseen:
            text = _collapsed(parts)
            if text:
                linked = len(text) - len(_collapsed(plain)) if len(plain) < len(parts) else 0
                lines.append(Line(text, linked, now.article, now.around, now.form))
        parts.clear()
        plain.clear()

    def pop() -> None:
        nonlocal now, links, headings
        gone = stack.pop()
        count[gone.name] -= 1
        links -= gone.name == "a"
        headings -= gone.name in HEADINGS
        now = stack[-1] if stack else _TOP

    for text, closing, name, attributes in _tokens(html):
        if text is not None:
            parts.append(text)
            if headings or not links:
                plain.append(text)
            continue
        block = name not in INLINE
        if block:
            flush()
        if closing:
            if not count[name]:
                continue
            if not block:
                at = len(stack) - 1
                while stack[at].name != name:
                    at -= 1
                if now[1:] != (stack[at - 1] if at else _TOP)[1:]:
                    flush()
                while len(stack) > at:
                    pop()
            else:
                while stack[-1].name != name:
                    pop()
                pop()
        elif name not in RAW and name not in VOID:
            if stack and (block and stack[-1].name == "p" or name in SIBLINGS and stack[-1].name == name):
                pop()
            around = name in OUTSIDE or name == "header" and not now.article
            if not around and attributes and not attributes.isspace() and name not in ("html", "body", "article", "main"):
                around = _is_around(attributes, now.article)
            around = around or name == "article" and "comment" in attributes.lower()
            article = now.article or name in ("article", "main") and not around
            opened = _Open(name, now.unseen or name in UNSEEN, article, now.around or around, now.form or name == "form")
            if not block and opened[1:] != now[1:]:
                flush()
            stack.append(opened)
            count[name] += 1
            links += name == "a"
            headings += name in HEADINGS
            now = opened
    flush()
    return lines


def line_weights(lines: list[Line]) -> list[float]:
    """What each line adds to the sums of its windows."""
    named = any(x.article and not x.around for x in lines)
    weights = []
    for x in lines:
        plain = len(x.text) - 2 * x.linked
        if x.around:
            weight = plain / 16 - 4 * PENALTY
        elif x.form:
            weight = plain / 4 - 1.25 * PENALTY
        elif x.article:
            weight = plain - COST + BONUS
        else:
            weight = plain / 8 - 2 * PENALTY if named else plain
        weights.append(weight)
    return weights


def text_lines(lines: list[Line], window: int = WINDOW, threshold: int = THRESHOLD) -> list[int]:
    """Numbers of the lines between surge and dive points."""
    weights = line_weights(lines)
    kept: list[int] = []
    start = 0
    for end in [i for i, w in enumerate(weights) if w <= -PENALTY] + [len(lines)]:
        kept += _stretch(lines, weights, start, end, window, threshold)
        start = end + 1
    unlifted = {i for i, x in enumerate(lines) if x.article and weights[i] > -PENALTY and len(x.text) >= 2 * x.linked and not x.around and not x.form}
    if not kept:
        return sorted(unlifted | {i for i, w in enumerate(weights) if w > 0})
    return sorted(unlifted.union(kept)) if unlifted else kept


def _stretch(lines: list[Line], weights: list[float], start: int, end: int, window: int, threshold: int) -> list[int]:
    """The same inside a stretch without a break."""
    best = []  # the largest sum of a window that begins at the line
    for i in range(start, end):
        total, most = 0.0, -float("inf")
        for w in weights[i : min(end, i + window)]:
            total += w
            most = max(most, total)
        best.append(most)
    surges = [i for i in range(start, end) if weights[i] > 0 and best[i - start] >= threshold]
    dives = [i for i in range(start, end) if best[i - start] <= 0]
    kept: list[int] = []
    at = 0  # the next dive to look at
    for nth, surge in enumerate(surges):
        while at < len(dives) and dives[at] < surge:
            at += 1
        following = surges[nth + 1] if nth + 1 < len(surges) else None
        dive = dives[at] if at < len(dives) else end
        stop = following if following is not None and dive >= following else min(dive, surge + window, end)
        kept += range(surge, stop)
    if kept:
        kept = _with_edges(lines, kept, start, end, window)
    return kept


def _with_edges(lines: list[Line], kept: list[int], start: int, end: int, window: int) -> list[int]:
    """Short runs of article lines that lie between the text and the ends of its stretch."""
    first, last = kept[0], kept[-1]
    before = range(start, first) if first - start < window and all(x.article for x in lines[start:first]) else range(0)
    after = range(last + 1, end) if end - last - 1 < window and all(x.article for x in lines[last + 1 : end]) else range(0)
    return [*before, *kept, *after]


def main_text(html: str | None, window: int = WINDOW, threshold: int = THRESHOLD) -> str:
    """The main text of a page: its blocks joined by one space."""
    if not html:
        return ""
    lines = page_lines(html)
    return " ".join(lines[i].text for i in text_lines(lines, window, threshold))


def extract(pages: DataFrame, window: int = WINDOW, threshold: int = THRESHOLD) -> DataFrame:
    """Per page: page_id, url, main text and its length."""

    def row(page_id, url, html):
        text = main_text(html, window, threshold)
        yield page_id, url, text, len(text)

    return map_rows(pages.select("page_id", "url", "html"), "page_id long, url string, text string, n_chars long", lambda: row)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
