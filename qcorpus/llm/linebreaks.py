"""Main text of web pages by the distribution of text over line blocks.

The page is cut into lines, one for each block element. A line weighs the characters that it has
outside links, nothing if it is links for the most part. Weights are summed over a sliding window
of lines. A run of lines begins where the sum leaves zero and ends where it dives to zero again; it
is text if the sum surges over a threshold on the way, a quarter of the page's greatest sum, at most
``MOST_SURGE`` characters. What stands between surge and dive is kept: short lines, lines of links,
and what follows adverts, as lines that are left out count as one.

Markup is evidence for the weights. Lines of elements that cannot hold the article (navigation,
header, footer, sidebar, form, advert, notice, comments), by element or by a class, id
or role that names nothing else, weigh nothing and are left out; a phrase within the article is part of it. Where a page has an article or main element, lines outside
it weigh nothing and lines inside weigh all their characters and need no surge.

Defined cases: null or empty pages give an empty text; a page without markup is its own single
block; markup that is cut off at the end of the page is dropped with what it would open; elements
that are not closed end with what holds them; pages of any size are read in one pass; repeated rows
give equal results; an empty table stays empty; a caller's column named as the text is replaced, all
others but the html are kept.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_slices, raw_texts, with_added

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", re.S)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "select", "button"}
_SKIP = {"nav", "header", "footer", "aside", "form", "head", "menu", "dialog"}
_BLOCK = {
    "address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "h1", "h2",
    "figure", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot",
    "th", "thead", "tr", "ul", "caption",
} | _SKIP
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements of which an open one ends where another of a kind begins; a paragraph ends at any block.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}
_ATTRIBUTE = re.compile(r"(class|id|role|aria-label|hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
#: Words of a class, id or role that mark boilerplate, and words that may stand beside them in one name.
_MARKS = set(
    "ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion comment comments commentlist disqus replies "
    "sidebar side aside widget menu nav navigation navbar breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended toolbar pagination pager "
    "skip complementary contentinfo search".split()
)
_BESIDE = set(
    "site page main global top bottom left right primary secondary box bar block container content wrapper wrap inner outer section area slot list item items "
    "links link posts articles stories form field button buttons icon icons icons row col column sticky fixed mobile desktop small large big new the a of and in "
    "media reader user article post news blog c g js is has".split()
)
_NAME_PARTS = re.compile(r"[A-Za-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")
_RIGHTS = re.compile(r"\s*(?:\u00a9|\(c\)\s|copyright\b)", re.I)
MOST_SURGE = 80


def _unwanted(tag: str, attributes: str) -> bool:
    if tag in _SKIP:
        return True
    if tag in ("html", "body") or not attributes:
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        value = value.strip("\"'")
        name = name.lower()
        if name == "hidden" or name == "style" and _HIDDEN.search(value):
            return True
        if name in ("class", "id", "role", "aria-label") and any(_marks(part) for part in value.split()):
            return True
    return False


@lru_cache(1 << 12)
def _marks(name: str) -> bool:
    """A class, id or role that names boilerplate and nothing else, as "site-footer" does and "related-work" does not."""
    parts = {x.lower() for x in _NAME_PARTS.findall(name)}
    return bool(parts & _MARKS) and parts <= _MARKS | _BESIDE


class _Tag(NamedTuple):
    start: int
    end: int
    name: str
    closing: bool
    attributes: str


def _tags(page: str) -> Iterator[_Tag]:
    """Tags in order; what scripts and the like hold is part of their tag, as are comments (without a name)."""
    at = 0
    while mark := _MARK.search(page, at):
        at = mark.end()
        name = (mark[2] or "").lower()
        if name in _RAW and not mark[1]:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        yield _Tag(mark.start(), at, name, bool(mark[1]), mark[3] or "")


def _spans(tags: list[_Tag], length: int) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Where elements that seem unwanted, and where article elements begin and end."""
    unwanted: list[tuple[int, int, str]] = []
    articles: list[tuple[int, int, str]] = []
    odd: list[tuple[int, int, str]] = []  # article elements that seem unwanted
    # open blocks, each with the open inline elements in it that seem unwanted
    blocks: list[tuple[_Tag, bool, list[_Tag]]] = []
    open_blocks: Counter[str] = Counter()

    def end_block(at: int) -> str:
        tag, bad, inlines = blocks.pop()
        open_blocks[tag.name] -= 1
        if tag.name in ("article", "main"):
            (odd if bad else articles).append((tag.start, at, tag.name))
        elif bad:
            unwanted.append((tag.start, at, tag.name))
        unwanted.extend((x.start, at, x.name) for x in inlines)
        return tag.name

    for tag in tags:
        if not tag.name or tag.name in _RAW or tag.name in _VOID:
            continue
        if tag.closing:
            if tag.name not in _BLOCK:
                inlines = blocks[-1][2] if blocks else []
                if any(x.name == tag.name for x in inlines[-8:]):
                    while (x := inlines.pop()).name != tag.name:
                        unwanted.append((x.start, tag.start, x.name))
                    unwanted.append((x.start, tag.end, x.name))
            elif open_blocks[tag.name]:
                while end_block(tag.end) != tag.name:
                    pass
            continue
        bad = _unwanted(tag.name, tag.attributes)
        if tag.name in _BLOCK:
            ends = _ENDS.get(tag.name, set())
            while blocks and (blocks[-1][0].name in ends or blocks[-1][0].name == "p"):
                end_block(tag.start)
            blocks.append((tag, bad, []))
            open_blocks[tag.name] += 1
        elif bad and blocks:
            if not open_blocks["article"] + open_blocks["main"]:  # within the text a phrase is part of it
                blocks[-1][2].append(tag)
        elif bad:
            blocks.append((_Tag(0, 0, "body", False, ""), False, [tag]))
            open_blocks["body"] += 1
    while blocks:
        end_block(length)
    return sorted(unwanted + odd if articles else unwanted), sorted(articles or odd)


def _left_out(tags: list[_Tag], length: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans to leave out, and those of the page's article elements; neither overlap themselves."""
    unwanted, articles = _spans(tags, length)
    begins = [a for a, _, _ in articles]
    out: list[tuple[int, int]] = []
    for a, b, name in unwanted:
        i = bisect_left(begins, a + 1)
        holds = i < len(begins) and begins[i] < b if articles else 2 * (b - a) > length
        if holds and (name not in _SKIP or name == "form") or out and a < out[-1][1]:
            continue
        out.append((a, b))
    whole: list[tuple[int, int]] = []
    for a, b, _ in articles:
        if not whole or a >= whole[-1][1]:
            whole.append((a, b))
    return out, whole


class Line(NamedTuple):
    text: str
    plain: int  # characters outside links
    inside: bool  # in an article element
    left_out: bool


def page_lines(page: str) -> list[Line]:
    """The lines of a page, those to leave out too."""
    tags = list(_tags(page))
    out, articles = _left_out(tags, len(page))
    lines: list[Line] = []
    parts: list[str] = []
    linked = link_depth = at = next_out = next_article = 0

    def end_line(place: int) -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                gone = next_out < len(out) and out[next_out][0] < place
                inside = next_article < len(articles) and articles[next_article][0] < place
                lines.append(Line(text, max(0, len(text) - linked), inside, gone))
            parts.clear()
        linked = 0

    for tag in [*tags, _Tag(len(page), len(page), "html", True, "")]:
        if tag.start > at:
            text = page[at : tag.start]
            parts.append(text)
            if link_depth:
                linked += len(text)
        borders = tag.name in _BLOCK
        # a span begins before its first tag and ends after its last, or before the tag that ends it
        if next_out < len(out) and (tag.start == out[next_out][0] or tag.end >= out[next_out][1]):
            borders = True
        if borders:
            end_line(tag.start)
            link_depth = 0
        while next_out < len(out) and tag.end >= out[next_out][1]:
            next_out += 1
        while next_article < len(articles) and tag.end >= articles[next_article][1]:
            next_article += 1
        at = tag.end
        if tag.name == "a":
            link_depth = max(0, link_depth + (-1 if tag.closing else 1))
        elif tag.name == "br":
            parts.append(" ")
    return lines


def _closed_up(lines: list[Line]) -> list[Line]:
    """The lines with one for each run of lines that are left out, however many it has."""
    return [x for x, before in zip(lines, [None, *lines]) if not (x.left_out and before is not None and before.left_out)]


def main_text(page: str, window: int = 3, most_surge: int = MOST_SURGE) -> str:
    """The lines between the surge and dive points of the page's line blocks, joined by line breaks."""
    lines = _closed_up(page_lines(page))
    within = any(x.inside and not x.left_out for x in lines)
    own = [not x.left_out and (x.inside or not within) for x in lines]

    def weight(line: Line) -> int:
        if line.inside:
            return len(line.text)
        return 0 if 2 * line.plain < len(line.text) or _RIGHTS.match(line.text) else line.plain

    weights = np.array([weight(x) if o else 0 for x, o in zip(lines, own)], np.int64)
    if not weights.any():
        return ""
    sums = np.convolve(weights, np.ones(window, np.int64))  # over the lines up to here
    surge = min(most_surge, int(sums.max()) // 4)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], sums > 0, [0]))))
    kept: list[str] = []
    for first, dive in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if within or sums[first:dive].max() >= surge:
            last = dive - window + 1  # after the last line with weight
            kept += [x.text for x, o in zip(lines[first:last], own[first:last]) if o]
    return "\n".join(kept)


def _extract(batches: Iterator[pa.RecordBatch], html_col: str, stay: list[str], text_name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in byte_slices([batch], html_col, 4 << 20):
            texts = [main_text(x.decode()) for x in raw_texts(part.column(html_col))]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in stay] + [pa.array(texts, pa.string())], names=[*stay, text_name])


def extract_main_text(pages: DataFrame, html_col="html", text_name="text") -> DataFrame:
    """``pages`` without the html and with the main text in ``text_name``."""
    rows, stay, out = with_added(pages, html_col, False, f"{text_name} string")
    return rows.mapInArrow(lambda batches: _extract(batches, html_col, stay, text_name), out)
