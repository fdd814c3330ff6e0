"""Main-text extraction by line-block distribution.

Markup is stripped to lines, one per block element; inline elements and line breaks do not end a line. Over
the lines, the text lengths of sliding windows of three lines are summed; lines that are mostly links count
as empty. The text surges where a window holds more than a threshold and dives where one holds nothing. The
stretches between dives that surge, from their first to their last line that is not mostly links, are the
main text, in page order; where nothing surges all stretches are.

What the page says of its parts is a prior. Menus, footers, asides, dialogs, hidden parts, embedded parts and
those whose class or id names them (``sidebar``, ``ad``, ``comment-list``, ``user-comments``) give no lines,
however long they are; a header gives none outside of an ``article`` element. A name counts where all its words
belong to such parts (``related-posts``, ``cookie-notice``); a word of another kind makes it a name of text
(``related-work``, ``share-price``), and words that text carries as well (``related``, ``form``, ``share``) count
only where no other name of the container has such a word. A form goes, unless it has no control that is seen,
encloses an article, or holds several paragraphs for each control (a page wrapped in a form). No rule of these
asks for a length. Where the page marks articles, the distribution is taken within each: those in which text
surges (or all, if none does) are the main text, from their first line to their last, so short lines stay.

Rows: a null or empty html, or one without text, gives an empty text. Attributes follow the rules of HTML
(a quote inside an unquoted value is part of it). Unclosed and stray tags are tolerated, at linear cost; a
``<`` that opens no tag is text; an unclosed script, style, title, textarea or comment ends with the page, any
other unclosed element with its parent. Repeated pages each get their row.
"""

from __future__ import annotations

import functools
import html
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .textkit import give_back

WINDOW = 3
#: Characters of a window at which the text surges.
SURGE = 86
#: Paragraphs for each control that make a form a wrapper of text.
PARAGRAPHS = 3
#: Share of a line's characters that may be links.
LINKS = 0.5

_VALUE = r"\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*+))"
_TOKEN = re.compile(
    r"<!--(?:-?>|(?s:.*?)(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)"
    rf"|<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[\s/]++|=?[^\s/>=]++(?:{_VALUE})?+|=)*+)(?:>|\Z)|(?P<text>[^<]++|<)"
)
_END_OF = {t: re.compile(rf"</{t}\s*>|\Z", re.I) for t in ("script", "style", "textarea", "title")}
_ATTR = re.compile(rf"([^\s/>=]++)(?:{_VALUE})?+")
_TOLD = re.compile(r"class|id|role|hidden|style", re.I)
_PART = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")

# fixed values: names of elements, roles, classes and ids
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BOILER = frozenset("nav footer aside menu dialog button".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Elements whose contents are no lines.
_UNSEEN = frozenset("noscript template iframe svg select object datalist".split())
_CONTROLS = frozenset("input select textarea button".split())
#: Words that name a part which is no text.
_SURE = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer ad ads advert adverts advertisement advertising banner promo sponsor sponsored cookie cookies gdpr"
    " popup modal newsletter comment comments commentlist disqus pagination pager".split()
)
#: Words that no text carries even as a part of a longer name, outside of articles.
_SURE_PART = frozenset("navbar menubar breadcrumb breadcrumbs sidebar footer advert adverts advertisement cookie cookies gdpr newsletter comments disqus pagination".split())
#: Words that text carries as well.
_MAYBE = frozenset(
    "aside promotion consent notice alert overlay subscribe subscription signup login share sharing social reply replies respond related recommended"
    " recommendations widget toolbar form search".split()
)
#: Words that go with either kind.
_HELPERS = frozenset(
    "list section box area wrap wrapper container inner outer block item items bar row col column group panel holder slot unit space zone region user users reader readers left right top"
    " bottom upper lower side main primary secondary site page post posts entry story stories article articles news more link links button buttons icon icons count counter thread feed"
    " policy message text body content title head header heading label wp js google dfp the and by of to our your us".split()
)
#: Elements of text itself, of which no name makes a container.
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption html body article main".split())
_AUTO_CLOSE = frozenset(("p", "li", "dt", "dd", "tr", "td", "th", "option"))

#: What an element's tag and attributes say: text, a form (see ``lines``), or no part of the main text.
_KEEP, _FORM, _DROP = range(3)


@functools.lru_cache(maxsize=4096)
def _named(names: tuple[str, ...]) -> bool:
    """Whether the names of a container are those of a part that is no text."""
    of_text = maybe = False
    for name in names:
        parts = [p for p in _PART.split(name) if p and not p[0].isdigit() and len(p) > 1]
        known = all(p in _SURE or p in _MAYBE or p in _HELPERS for p in parts)
        if known and not _SURE.isdisjoint(parts):
            return True
        of_text |= not known
        maybe |= not _MAYBE.isdisjoint(parts)
    return maybe and not of_text


def _prior(tag: str, attrs: str, in_article: bool, in_element: bool) -> int:
    """``in_article``: inside of an article or main part; ``in_element``: inside of an ``article`` element."""
    if tag in _BOILER or tag in _UNSEEN or (tag == "header" and not in_element):
        return _DROP
    found = _FORM if tag == "form" else _KEEP
    if not attrs or tag in ("html", "body") or not _TOLD.search(attrs):
        return found
    held: list[str] = []
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role":
            if value in _ROLES:
                return _DROP
            if value == "form":
                found = _FORM
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return _DROP
        elif name in ("class", "id"):
            held += value.split()
    parts = {p for n in held for p in _PART.split(n)}
    if tag in ("article", "main"):  # an article may be a reader's comment or an advert
        return found if {"comment", "comments", "ad", "ads"}.isdisjoint(parts) else _DROP
    if tag in _TEXT:
        return _DROP if not _SURE.isdisjoint(held) and not in_article else found
    if not _SURE.isdisjoint(held) or (not in_article and ("header" in parts or not _SURE_PART.isdisjoint(parts))) or _named(tuple(held)):
        return _DROP
    return found


def lines(page: str) -> tuple[list[tuple[str, int, float, int]], set[int]]:
    """(text, article, share of links, form) of each line in page order, and the forms that are none; 0 is outside of any.

    Dropped elements give no lines.
    """
    out: list[tuple[str, int, float, int]] = []
    stack: list[tuple[str, bool, int, int]] = []  # element, dropped, article, form
    depth: Counter = Counter()  # open elements by name
    controls, paragraphs, wraps = Counter(), Counter(), set()  # of forms
    text: list[str] = []
    linked = dropped = article = articles = form = forms = in_link = 0

    def end_line() -> None:
        nonlocal linked
        s = " ".join(html.unescape("".join(text)).split())
        if s:
            out.append((s, article, linked / len(s), form))
            if form and stack and stack[-1][0] in ("p", "blockquote", "pre"):
                paragraphs[form] += 1
        text.clear()
        linked = 0

    def pop() -> None:
        nonlocal dropped, article, form
        depth[stack.pop()[0]] -= 1
        dropped, article, form = stack[-1][1:] if stack else (False, 0, 0)

    at = 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        if m["text"] is not None:
            if not dropped:
                text.append(m["text"])
                if in_link:
                    linked += len(" ".join(html.unescape(m["text"]).split()))
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag not in _INLINE:
            end_line()
        elif tag in ("br", "img", "wbr"):
            text.append("" if tag == "wbr" else " ")
        if m["close"]:
            if tag == "a":
                in_link = 0
            if depth[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if form and tag in _CONTROLS and not (tag == "input" and "hidden" in m["attrs"].lower()):
            controls[form] += 1
        if tag in _END_OF:
            at = _END_OF[tag].search(page, at).end()
            continue
        if tag in _VOID or (tag in _INLINE and tag != "a" and not m["attrs"].strip()) or (tag in _UNSEEN and m["attrs"].rstrip().endswith("/")):
            continue
        if tag == "a":
            in_link = 1
            continue
        if tag in _AUTO_CLOSE and stack and stack[-1][0] == tag:
            pop()
        prior = _DROP if dropped else _prior(tag, m["attrs"], bool(article), depth["article"] > 0)
        dropped = prior == _DROP
        if tag in ("article", "main") and not dropped and not article:
            articles += 1
            article = articles
            if form:
                wraps.add(form)
                form = 0
        if prior == _FORM and not form:
            forms += 1
            form = forms
        stack.append((tag, dropped, article, form))
        depth[tag] += 1
    end_line()
    return out, {f for f in range(1, forms + 1) if f in wraps or paragraphs[f] >= PARAGRAPHS * controls[f]}


def main_lines(found: list[tuple[str, int, float, int]], no_forms: set[int]) -> list[str]:
    """The lines of the stretches that surge, or of the articles in which text surges."""
    found = [line for line in found if not line[3] or line[3] in no_forms]
    articles: dict[int, list] = {}
    for line in found:
        if line[1]:
            articles.setdefault(line[1], []).append(line)
    if articles:  # short lines at or between the stretches of an article are its text
        surging = [own for own in articles.values() if any(surged for surged, _, _ in stretches(_sizes(own)))]
        return [line[0] for own in surging or articles.values() for line in own]
    spans = stretches(_sizes(found))
    surging = [x for x in spans if x[0]]
    return [line[0] for _, a, b in surging or spans for line in found[a:b]]


def _sizes(found: list[tuple[str, int, float, int]]) -> list[int]:
    return [0 if share > LINKS else len(s) for s, _, share, _ in found]


def window_sums(sizes: list[int]) -> list[int]:
    """Sums of the windows that start at each line."""
    whole = [0, *itertools.accumulate(sizes)]
    return [whole[min(i + WINDOW, len(sizes))] - whole[i] for i in range(len(sizes))]


def stretches(sizes: list[int]) -> list[tuple[bool, int, int]]:
    """(surges, first, end) of the stretches between dives, without empty lines at their edges."""
    out, start, surged = [], None, False
    for i, n in enumerate([*window_sums(sizes), 0]):
        if n and start is None:
            start, surged = i, False
        surged |= n > SURGE
        if not n and start is not None:
            full = [k for k in range(start, i) if sizes[k]]
            out.append((surged, full[0], full[-1] + 1))
            start = None
    return out


def main_text(page: str | None) -> str:
    return "\n\n".join(main_lines(*lines(page))) if page else ""


def extract_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``pages`` with ``text``; one pass, no shuffle."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for htmls in batches:
                yield pd.Series([main_text(x) for x in htmls], dtype=object)
        finally:
            give_back()

    return pages.withColumn("text", text(html_column))


def op4_html_text(spark, sf_dir):
    pages = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
