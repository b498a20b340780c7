"""HTML extraction by line-block distribution.

Markup is stripped so that each block element becomes one line and each border of a grouping
element (div, section, article, ...) an empty one.  A line weighs as much as it has characters
outside links, and a line of an article or main element ``HOME_WEIGHT`` times that.  Elements that
hold no article (nav, footer, form, ...), what is hidden, reader comments and adverts inside an
article and lines of links weigh nothing.  Other names of boilerplate are evidence only: outside an
article a line so named weighs ``NAMED`` of its length, inside one it weighs its plain length, so a
named section stays if its text surges by itself.  Weights are summed over windows of ``WINDOW``
lines.  A passage surges where a line's window sums up to ``SURGE``, reaching back to the border
before it, and dives at the first border whose window sums up to less.  The passages of the article
are kept; on a page without one, those of at least ``SHARE`` of the longest passage and the unnamed
lines between them.  On a page of short lines only, where nothing surges, the heaviest window does.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_texts

#: Lines of a window, least sum of a surge, the part of its length that a named line weighs, and the share of the longest passage that makes another one part of the page's text.
WINDOW, SURGE, NAMED, SHARE = 2, 86, 0.1, 0.25
#: What a character of an article weighs: one makes a surge, as no part of an article may be lost.
HOME_WEIGHT = 86

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas textarea select title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input meta link".split())
BORDERED = frozenset("body div section article main table td".split())
HOME = frozenset("article main".split())
BOILER = frozenset("nav header footer aside form menu dialog button fieldset head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
CLOSED_BY_SIBLING = {"p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
# Words of class and id names.
BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent copyright disclaimer disqus dialog footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination pager popup privacy promo promoted promotion recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription tags teaser toolbar tracking widget".split()
)
#: Words that name what is never part of an article, though it stands in one.
FOREIGN_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense breadcrumb breadcrumbs comment comments commentlist cookie cookies disqus footer login menu modal nav navbar navigation newsletter notice notices overlay pagination pager popup promo promoted replies reply respond share sharing sidebar signup sponsor sponsored subscribe toolbar tracking widget".split())

# Every alternative takes all that it looks at (or the rest of the page), so a page is read once.
_MARKUP = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Line(NamedTuple):
    text: str  # empty for a border
    weight: float  # 0 for what is never kept
    home: bool = False  # of an article
    named: bool = False


class _Open(NamedTuple):
    tag: str
    skip: bool = False
    named: bool = False
    home: bool = False


def _enter(tag: str, rest: str, outer: _Open) -> _Open:
    """The element with what it inherits and what its own name and attributes say.

    The names of an article itself say nothing, but those of one inside another do: comments are
    marked up as articles too.
    """
    home = outer.home or tag in HOME
    skip = outer.skip or tag in BOILER and not (tag == "header" and outer.home)
    named = outer.named and (outer.home or not home)
    if rest and not rest.isspace() and tag not in ("html", "body"):
        for name, *values in _ATTRIBUTE.findall(rest):
            name, value = name.lower(), "".join(values).lower()
            if name in ("class", "id"):
                words = _NAME.findall(value) if outer.home or tag not in HOME else ()
                skip = skip or home and not FOREIGN_NAMES.isdisjoint(words)
                named = named or not BOILER_NAMES.isdisjoint(words)
            elif name == "role" and value.strip() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                skip = True
    return _Open(tag, skip, named, home)


def lines_of(html: str) -> list[Line]:
    """The page's lines and borders, in order."""
    lines: list[Line] = []
    stack, depth = [_Open("")], Counter()
    text: list[str] = []
    linked, in_link, at = 0, False, 0

    def end_line(border: bool = False) -> None:
        nonlocal linked
        whole = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
        if whole:
            inside = stack[-1]
            plain = 0.0 if inside.skip or linked * 2 > len(whole) and (inside.named or not inside.home) else max(1.0, len(whole) - linked / 2)
            weight = plain * (1 if inside.home else NAMED) if inside.named else plain * (HOME_WEIGHT if inside.home else 1)
            lines.append(Line(whole, weight, inside.home, inside.named))
        if border:
            lines.append(Line("", 0.0))
        text.clear()
        linked = 0

    while m := _MARKUP.search(html, at):
        if m.start() > at:
            piece = html[at : m.start()]
            text.append(piece)
            if in_link:
                linked += len(piece)
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in RAW and not m["close"] and not (tag in ("svg", "math") and m["rest"].endswith("/")):
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag == "a":
            in_link = not m["close"]
        if tag == "br":
            text.append(" ")
        if m["close"]:
            if depth[tag]:
                if tag not in INLINE or stack[-1].tag == tag:
                    end_line()
                    while True:
                        gone = stack.pop().tag
                        depth[gone] -= 1
                        if gone in BORDERED:
                            end_line(border=True)
                        if gone == tag:
                            break
            elif tag not in INLINE:
                end_line()
            continue
        if tag in INLINE:
            if tag in VOID or not ((inside := _enter(tag, m["rest"], stack[-1])).skip or inside.named) or inside[1:] == stack[-1][1:]:
                continue
        end_line()
        if tag in VOID:
            continue
        while len(stack) > 1 and tag in CLOSED_BY_SIBLING.get(stack[-1].tag, ()):
            gone = stack.pop().tag
            depth[gone] -= 1
            if gone in BORDERED:
                end_line(border=True)
        if tag in BORDERED:
            end_line(border=True)
        stack.append(_enter(tag, m["rest"], stack[-1]))
        depth[tag] += 1
    text.append(html[at:])
    end_line()
    return lines


def window_sums(weights: list[float], window: int) -> list[float]:
    """The sum of the weights from each line on."""
    before = [0.0, *accumulate(weights)]
    return [before[min(i + window, len(weights))] - before[i] for i in range(len(weights))]


def passages(lines: list[Line], window: int = WINDOW, surge: float = SURGE) -> list[tuple[int, int]]:
    """(first, end) of the lines from each surge to its dive.  Where no window reaches ``surge`` the heaviest one does."""
    sums = window_sums([x.weight for x in lines], window)
    surge = min(surge, max(sums, default=0.0))
    found: list[tuple[int, int]] = []
    run, start = 0, -1  # the line behind the last border, the first line of an open passage
    for i, line in enumerate(lines):
        if line.text:
            if start < 0 and line.weight and sums[i] >= surge:
                start = run
            continue
        if start >= 0 and sums[i] < surge:
            found.append((start, i))
            start = -1
        if start < 0:
            run = i + 1
    return [*found, (start, len(lines))] if start >= 0 else found


def main_text(html: str | None, window: int = WINDOW, surge: float = SURGE) -> str:
    lines = lines_of(html or "")
    length = [len(x.text) if x.weight else 0 for x in lines]
    found = passages(lines, window, surge)
    size = {p: sum(length[p[0] : p[1]]) for p in found}
    unnamed = [p for p in found if 2 * sum(length[i] for i in range(*p) if lines[i].named) <= size[p]]
    found = unnamed or found
    if not found:
        return ""
    home = [p for p in found if any(lines[i].home and length[i] for i in range(*p))]
    rest = max((size[p] for p in found if p not in home), default=0)
    if home and sum(size[p] for p in home) >= SHARE * rest:
        return "\n".join(lines[i].text for p in home for i in range(*p) if length[i])
    kept = {i for p in found if size[p] >= SHARE * rest for i in range(*p) if length[i]}
    return "\n".join(lines[i].text for i in range(min(kept), max(kept) + 1) if i in kept or length[i] and not lines[i].named)


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = WINDOW, surge: float = SURGE) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row.

    Null, empty and text-free pages give an empty text.  Pages of any length and depth are read
    whole, in one pass.  Repeated rows stay, of equally long passages all count, and other columns
    are left behind.  An empty table gives an empty table.
    """

    def make(batch, pages):
        found = [main_text(p.decode() if p is not None else None, window, surge) for p in pages]
        return {"page_id": column(batch, "page_id"), "url": column(batch, "url"), "text": pa.array(found, pa.string()), "n_chars": pa.array(map(len, found), pa.int64())}

    kind = df.schema[id_col].dataType.simpleString().replace("bigint", "long")
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_texts(rows, "html", make, f"page_id {kind}, url string, text string, n_chars long")
