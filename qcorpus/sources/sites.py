"""Question parsers by site: a registry of small functions over a page's elements, dispatched by host.

A parser gets the page's root element and yields a question's text, option texts, answer and explanation. What a page does not
say is not made up: a question with fewer than two options, or without an answer, carries an error. Of questions of one
page with the same text the first counts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pages import links, profile_for_url

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


@dataclass
class Element:
    tag: str
    attributes: dict[str, str | None] = field(default_factory=dict)
    inner: list[Element | str] = field(default_factory=list)

    @property
    def classes(self) -> list[str]:
        return (self.attributes.get("class") or "").split()

    def walk(self) -> Iterator[Element]:
        """All elements within, in the order of the page."""
        stack = [x for x in reversed(self.inner) if isinstance(x, Element)]
        while stack:
            own = stack.pop()
            yield own
            stack.extend(x for x in reversed(own.inner) if isinstance(x, Element))

    def where(self, tag: str | None = None, css: str | re.Pattern | None = None) -> list[Element]:
        """Elements within of a tag and a class, given as its name or as a pattern that some class has."""
        fits = (lambda e: True) if css is None else (lambda e: css in e.classes) if isinstance(css, str) else (lambda e: any(map(css.search, e.classes)))
        return [e for e in self.walk() if (tag is None or e.tag == tag) and fits(e)]

    def text(self) -> str:
        parts: list[str] = []
        stack = self.inner[::-1]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                parts.append(x)
            elif x.tag not in ("script", "style"):
                stack.extend(reversed(x.inner))
        return " ".join(" ".join(parts).split())


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [Element("")]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("li", "p") and self.open[-1].tag == tag:
            self.open.pop()
        own = Element(tag, dict(attrs))
        self.open[-1].inner.append(own)
        if tag not in _VOID:
            self.open.append(own)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, max(0, len(self.open) - 40), -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].inner.append(data)


#: A run of text, or a tag whose attributes are all plain and quoted.
_PLAIN = re.compile(r"""([^<&]+)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \n]+[a-zA-Z][a-zA-Z-]*=(?:'[^'<>&]*'|"[^"<>&]*"))*)[ \n]*>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)=(?:'([^']*)'|"([^"]*)")""")
#: Elements whose content is no markup, or not all of it.
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext", "svg", "math"}


def _plain_tree(html: str) -> Element | None:
    """The tree of a page of nothing but text without references and plain tags, as the library's parser gives it; of others none."""
    tree, at = _Tree.__new__(_Tree), 0
    tree.open = [Element("")]
    for m in _PLAIN.finditer(html):
        if m.start() != at:
            return None
        at = m.end()
        text, closes, tag, attributes = m.groups()
        if text is not None:
            tree.handle_data(text)
            continue
        tag = tag.lower()
        if tag in _RAW or closes and attributes:
            return None
        if closes:
            tree.handle_endtag(tag)
        else:
            tree.handle_starttag(tag, [(k.lower(), x or y) for k, x, y in _ATTRIBUTE.findall(attributes)] if attributes else [])
    return tree.open[0] if at == len(html) else None


def page_tree(html: str) -> Element:
    plain = _plain_tree(html)
    if plain is not None:
        return plain
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.open[0]


Found = tuple[str, list[str], str | None, str | None]  # text, options, answer, explanation
Parser = Callable[[Element], Iterator[Found]]
PARSERS: dict[str, Parser] = {}
#: Characters of a question's text below which it is none.
LEAST_TEXT = 11


def parser(name: str) -> Callable[[Parser], Parser]:
    """Register a site's parser under a name, which a table of hosts gives to pages."""

    def add(f: Parser) -> Parser:
        PARSERS[name] = f
        return f

    return add


@dataclass(frozen=True)
class Blocks:
    """Where a site of question blocks keeps things: fixed values of its pages."""

    block: str = "bix-div-container"
    question: str = "bix-td-qtxt"
    option: str = "bix-td-option-val"
    answer: str = "jq-hdnakq"
    explanation: str = "bix-ans-description"


@parser("blocks")
def block_questions(page: Element, layout: Blocks = Blocks()) -> Iterator[Found]:
    """Blocks with a hidden answer; one with an empty option, which stands for an image, is left out."""
    for block in page.where("div", layout.block):
        first = lambda css, b=block: next(iter(b.where(css=css)), None)
        asked, told, answer = first(layout.question), first(layout.explanation), first(layout.answer)
        options = [o.text() for o in block.where(css=layout.option)]
        if asked is not None and len(options) >= 2 and all(options):
            yield asked.text(), options, answer.attributes.get("value") if answer is not None else None, told.text() if told is not None else None


@parser("cards")
def card_questions(page: Element) -> Iterator[Found]:
    """Cards with a list of lettered choices and the letter of the right one."""
    for card in page.where("div", "exam-question-card"):
        for body in card.where("div", "question-body")[:1]:
            said = [p.text() for p in body.where("p", "card-text")]
            tails = [t.rpartition("Question")[2].strip() for t in said if "Question" in t]
            plain = [t for t in said if t and "Question" not in t and "Introductory Info" not in t]
            text = next(iter([t for t in tails if t][-1:] or plain or said[-1:]), "")
            choices = [c for c in (li.text() for li in body.where("li", "multi-choice-item")) if c]
            letter = next((s.text() for s in body.where("span", "correct-answer")), "")
            right = next((c for c in choices if letter and (c.startswith(letter) or f" {letter}." in c)), None)
            yield text, choices, right, None


_NUMBERED = re.compile(r"Q?\d+[.)]")
_ASKS = re.compile(r"Q\d+[.:]?|\d+[.:]|(?:What|Which|Calculate|The)\b")
_LETTERED = re.compile(r"[a-dA-D][.)]")
_CONTENT = re.compile(r"(entry|page|post)-content", re.I)
_FOLDED = re.compile("collapse|answer", re.I)
_ASKING = re.compile("question|quiz|mcq|qa-item|entry-content", re.I)


@parser("paragraphs")
def paragraph_questions(page: Element) -> Iterator[Found]:
    """Numbered paragraphs, or ones that ask, each with the answer that the next folded part gives."""
    within = next(iter(page.where(css=_CONTENT)), page)
    rows = [e for e in within.walk() if e.tag == "p" or any(map(_FOLDED.search, e.classes))]
    for i, p in enumerate(rows):
        text = p.text()
        if p.tag == "p" and len(text) > 20 and (_NUMBERED.match(text) or text.endswith("?")):
            later = next((e for e in rows[i + 1 :] if any(map(_FOLDED.search, e.classes))), None)
            yield text, [], later.text() or None if later is not None else None, None


@parser("any")
def any_questions(page: Element) -> Iterator[Found]:
    """Sentences that ask, within parts that are named after questions, with the lettered lines beside them; else paragraphs that ask."""
    found = False
    for part in page.where(css=_ASKING):
        for holder in [part, *part.walk()]:
            inner = [e for e in holder.inner if isinstance(e, Element)]
            options = [t for t in (e.text() for e in inner + [x for e in inner if e.tag in ("ul", "ol") for x in e.where("li")] if e.tag in ("li", "div", "span")) if _LETTERED.match(t)]
            for e in inner:
                text = e.text()
                if e.tag in ("p", "div", "span") and len(text) > 15 and (_ASKS.match(text) or text.endswith("?")) and not (e.tag == "div" and e.where("p")):
                    found = True
                    yield text, options, None, None
    if not found:
        for p in page.where("p"):
            if p.text().endswith("?") and len(p.text()) > 15:
                yield p.text(), [], None, None


_SCHEMA = "url string, parser string, number int, question_text string, options array<struct<key:string,text:string>>, answer string, explanation string, error string"
_ARROW = pa.schema([
    ("url", pa.string()), ("parser", pa.string()), ("number", pa.int32()), ("question_text", pa.string()),
    ("options", pa.list_(pa.struct([("key", pa.string()), ("text", pa.string())]))), ("answer", pa.string()), ("explanation", pa.string()), ("error", pa.string()),
])


def site_questions(name: str, html: str) -> list[dict]:
    """The questions of a page by the parser of that name, by the one for any page if there is none."""
    name = name if name in PARSERS else "any"
    seen: set[str] = set()
    out = []
    for text, options, answer, told in PARSERS[name](page_tree(html)):
        if len(text) < LEAST_TEXT or text in seen:
            continue
        seen.add(text)
        error = "fewer than two options" if len(options) < 2 else "no answer" if not answer else None
        lettered = [{"key": chr(65 + i), "text": o} for i, o in enumerate(options)]
        out.append({"parser": name, "number": len(out) + 1, "question_text": text, "options": lettered, "answer": answer, "explanation": told or None, "error": error})
    return out


#: Questions that go to Spark at once, though a page's own stay together.
_ROWS = 1000


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    for batch in batches:
        for url, profile, html in zip(*(batch.column(c).to_pylist() for c in ("url", "profile", "html"))):
            rows += [{"url": url} | q for q in site_questions(profile, html or "")]
            if len(rows) >= _ROWS:
                yield from pa.Table.from_pylist(rows, _ARROW).to_batches()
                rows = []
    if rows:
        yield from pa.Table.from_pylist(rows, _ARROW).to_batches()


def parse_sites(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Questions of pages (url, html), each by the parser that ``hosts`` (host, profile) names for its host or a parent domain of it."""
    return profile_for_url(pages.select("url", "html"), hosts).select("url", "profile", "html").mapInArrow(_parse, _SCHEMA)


def reachable(pages: DataFrame, starts: DataFrame, follows: str = r"(?i)page|next|\d", most_rounds: int = 10_000) -> DataFrame:
    """(url, depth): the stored pages that links which look like paging lead to from ``starts`` (url), in rounds.

    ``follows`` is a pattern for a link's target. Links are read once; each round follows those of the pages that the last one
    found, less the ones visited before, until there is none. A page's depth is the fewest links to it.
    """
    from ..storage import stored

    known = pages.select("url").where("url is not null").distinct()
    steps = links(pages.select("url", "html")).where(F.col("target").rlike(follows) & (F.col("target") != F.col("url")))
    steps = stored(steps.select("url", F.col("target").alias("to")).distinct().join(known.withColumnRenamed("url", "to"), "to", "left_semi"), "steps")
    frontier = stored(starts.select("url").distinct().join(known, "url", "left_semi").withColumn("depth", F.lit(0)), "frontier")
    visited = frontier
    for depth in range(1, most_rounds):
        found = steps.join(frontier.select("url"), "url").select(F.col("to").alias("url")).distinct()
        frontier = stored(found.join(visited.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if not frontier.head(1):
            break
        visited = visited.unionByName(frontier)
    return visited
