"""Markdown escaping, safe HTML of plain texts, reading links and differences of texts.

What looks at one character or line at a time is a column expression; what carries state through a
text (code fences, a longest common subsequence) is a small Arrow function.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import escape_html, host, host_matches

#: The characters that Markdown reads as formatting anywhere in a line. They are escaped by a backslash.
MARKS = "\\`*_$[]~&|<@"
#: What stands in for the space that an indented line begins with.
SPACE_ENTITY = "&#32;"
#: Noncharacters that a parser puts around a rebuilt formula.
FORMULA_BEGIN, FORMULA_END, FORMULA = "\ufdd0", "\ufdd1", "\ufdd2"

_ESCAPES = str.maketrans({c: "\\" + c for c in MARKS})


def _fence_of(line: str) -> str:
    """The run of three or more ` or ~ that opens or closes a code block here, else nothing."""
    body = line.lstrip(" ")
    run = body[: len(body) - len(body.lstrip(body[:1]))] if body[:1] in ("`", "~") else ""
    return run if len(run) >= 3 and len(line) - len(body) <= 3 else ""


def _lines(text: str) -> Iterator[tuple[str, bool]]:
    """The lines of a text, and whether each belongs to a fenced code block, its fences included."""
    opened = ""
    for line in text.split("\n"):
        run = _fence_of(line)
        yield line, bool(opened or run)
        if not opened:
            opened = run
        elif run.startswith(opened):
            opened = ""


def _escaped_marker(body: str) -> str:
    """A line without its leading space, with a backslash before what makes it a heading, quote or item."""
    word = body.split(None, 1)[0] if body else ""
    whole = word == body
    heading = 0 < len(word) <= 6 and not word.strip("#")
    item = word in ("-", "+") and not whole
    if body.startswith(">") or heading or item:
        return "\\" + body
    if word[:-1].isdecimal() and word[-1] in ".)" and not whole:
        return word[:-1] + "\\" + body[len(word) - 1 :]
    return body


def _as_prose(line: str) -> str:
    body = line.lstrip()
    pad = line[: len(line) - len(body)]
    if body and len(pad) <= 3 and not body.rstrip().strip("-="):  # would underline a heading
        return pad + "\\" + body
    body = body.translate(_ESCAPES)
    body = re.sub(r"(?i)\b(?:(?:https?|ftp)(?=://)|www(?=\.))", r"\g<0>\\", body)  # bare addresses become links
    if pad.startswith(("\t", "    ")):
        return SPACE_ENTITY + pad[1:] + body
    return pad + _escaped_marker(body)


def escape_markdown_text(text: str) -> str:
    """``text`` so that Markdown shows it as it is; fenced code blocks stay as they are."""
    return "\n".join(line if fenced else _as_prose(line) for line, fenced in _lines(text))


def escape_markdown_formulas(text: str) -> str | None:
    """The same for a text with marked formulas, which come out as $...$.

    Null if the marks do not pair up or a formula stands in a code block.
    """
    prose, *rest = text.split(FORMULA_BEGIN)
    formulas = []
    for part in rest:
        formula, mark, after = part.partition(FORMULA_END)
        if not mark or FORMULA_END in after:
            return None
        formulas.append(formula)
        prose += FORMULA + after
    if FORMULA_END in text.split(FORMULA_BEGIN)[0] or any(fenced and FORMULA in line for line, fenced in _lines(prose)):
        return None
    first, *others = escape_markdown_text(prose).split(FORMULA)
    return first + "".join(f"${f}${x}" for f, x in zip(formulas, others))


def escape_markdown(text: Column, formulas: bool = False) -> Column:
    escape_one = escape_markdown_formulas if formulas else escape_markdown_text

    @F.pandas_udf(T.StringType())
    def escape(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else escape_one(t))

    return escape(text)


def safe_html(text: Column) -> Column:
    """A plain text as HTML: escaped, http links made links, line breaks kept."""
    escaped = escape_html(text)
    linked = F.regexp_replace(escaped, r"(https?://[^\s<&\"]+)", '<a href="$1" rel="nofollow noopener">$1</a>')
    return F.replace(linked, F.lit("\n"), F.lit("<br>"))


def with_reading_links(explanation: Column, links: Column) -> Column:
    """The explanation with a list of its further readings; links are http(s), once each, not yet named."""
    base = F.coalesce(explanation, F.lit(""))
    good = F.filter(links, lambda x: x["url"].rlike(r"^https?://[^\s<>\"]+$") & ~F.contains(base, x["url"]))
    urls = F.transform(good, lambda x: x["url"])
    first = F.filter(good, lambda x, i: F.array_position(urls, x["url"]) == i + 1)
    lines = F.transform(first, lambda x: F.concat(F.lit("- ["), F.coalesce(F.nullif(F.trim(x["text"]), F.lit("")), x["url"]), F.lit("]("), x["url"], F.lit(")")))
    body = F.concat_ws("\n\n", F.nullif(base, F.lit("")), F.concat(F.lit("Further reading:\n"), F.array_join(lines, "\n")))
    return F.when(F.size(lines) > 0, body).otherwise(explanation)


def is_menu_link(url: Column, site: str, sections: tuple[str, ...]) -> Column:
    """The link leads to the site's front page or straight to one of its sections, not to content."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"^/(?:[a-z]{2}-[a-z]{2}(?=/|$))?|/$", "")
    path = F.regexp_replace(path, r"^/", "")
    return F.coalesce(host_matches(host(url), F.lit(site)) & ((path == "") | path.isin(*sections)), F.lit(False))


def data_uri(text: Column) -> Column:
    """(mime, content) of a base64 data URI; null if it is none."""
    pattern = r"^data:([a-z]+/[a-z0-9.+-]+);base64,([A-Za-z0-9+/=\s]+)$"
    mime, body = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    content = F.try_to_binary(F.regexp_replace(body, r"\s", ""), F.lit("base64"))
    return F.when((mime != "") & content.isNotNull(), F.struct(mime.alias("mime"), content.alias("content")))


class CommonSubsequence:
    """Lengths of the longest common subsequences of all ends of two lists.

    A row of the table is one integer, whose bits tell where the length does not grow (the
    bit-parallel algorithm of Crochemore and others, 2001). Only every so many rows are kept and those
    between are worked out again, so two lists of n and m words take about m * sqrt(n) / 4 bytes.
    """

    def __init__(self, a: list[str], b: list[str]):
        self.a, self.n, self.m = a, len(a), len(b)
        self.all = (1 << self.m) - 1
        self.places: dict[str, int] = {}
        for j, word in enumerate(reversed(b)):
            self.places[word] = self.places.get(word, 0) | 1 << j
        self.step = max(1, int(self.n**0.5))
        self.kept = [self.all]  # the rows of the last 0, step, 2 * step, ... words of a
        row = self.all
        for i, word in enumerate(reversed(a), 1):
            row = self._next(row, word)
            if i % self.step == 0:
                self.kept.append(row)
        self.block, self.rows = -1, [self.all]

    def _next(self, row: int, word: str) -> int:
        hit = row & self.places.get(word, 0)
        return (row + hit | row - hit) & self.all

    def length(self, i: int, j: int) -> int:
        """Of a from i on and b from j on."""
        block, inside = divmod(self.n - i, self.step)
        if block != self.block:
            self.block, self.rows = block, [self.kept[block]]
        while len(self.rows) <= inside:
            self.rows.append(self._next(self.rows[-1], self.a[self.n - block * self.step - len(self.rows)]))
        size = self.m - j
        return size - (self.rows[inside] & (1 << size) - 1).bit_count()


def _bare(word: str) -> str:
    """A word in lower case without the marks around it; those inside count."""
    marks = [i for i, c in enumerate(word) if c.isalnum()]
    return word[marks[0] : marks[-1] + 1].lower() if marks else ""


def _matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; of several, the one that leaves out words of ``a`` first."""
    table = CommonSubsequence(a, b)
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif table.length(i + 1, j) >= table.length(i, j + 1):
            i += 1
        else:
            j += 1
    return out


def word_difference(old: str, new: str) -> dict[str, list[dict[str, str]]]:
    """The tokens of both sides, white space among them, each with its kind: same, removed or added.

    Words are compared without case and the marks around them.
    """
    sides, places, pairs = _words_compared(old, new)
    out = []
    for k, (side, place, kind) in enumerate(zip(sides, places, ("removed", "added"))):
        other = set(place) - {place[pair[k]] for pair in pairs}
        out.append([{"text": t, "kind": kind if i in other else "same"} for i, t in enumerate(side)])
    return {"existing": out[0], "candidate": out[1]}


def _words_compared(old: str, new: str) -> tuple[list[list[str]], list[list[int]], list[tuple[int, int]]]:
    """The tokens of both sides, the places of their words, and the pairs of words that are the same."""
    sides = [[t for t in re.split(r"(\s+)", text) if t] for text in (old, new)]
    places = [[i for i, t in enumerate(side) if not t.isspace()] for side in sides]
    return sides, places, _matches(*[[_bare(side[i]) for i in place] for side, place in zip(sides, places)])


_TOKENS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("kind", T.StringType())]))


def word_diff(old: Column, new: Column) -> Column:
    """(existing, candidate): the tokens (text, kind) of two question texts; null is an empty text."""

    @F.pandas_udf(T.StructType([T.StructField("existing", _TOKENS), T.StructField("candidate", _TOKENS)]))
    def diff(olds: pd.Series, news: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([word_difference(a or "", b or "") for a, b in zip(olds, news)], columns=["existing", "candidate"])

    return diff(old, new)


def word_counts(old: Column, new: Column) -> Column:
    """(same, removed, added): how many tokens of :func:`word_diff` are of each kind, ``same`` of the old text; spaces do not count, line breaks do.

    No token leaves its text's turn, where those of a batch of texts are many times the texts.
    """

    @F.pandas_udf("same int, removed int, added int")
    def count(olds: pd.Series, news: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(olds), 3), np.int32)
        for n, (a, b) in enumerate(zip(olds, news)):
            sides, places, pairs = _words_compared(a or "", b or "")
            removed, added = (len(p) - len(pairs) for p in places)
            out[n] = sum(1 for t in sides[0] if t.strip(" ")) - removed, removed, added
        return pd.DataFrame(out, columns=["same", "removed", "added"])

    return count(old, new)


def line_hunks(old: str, new: str) -> list[dict[str, object]]:
    """Runs of lines that differ: where they begin on either side (from 1), and the lines of each."""
    a, b = old.splitlines(), new.splitlines()
    out, i, j = [], 0, 0
    for x, y in [*_matches(a, b), (len(a), len(b))]:
        if x > i or y > j:
            out.append({"old_start": i + 1, "new_start": j + 1, "removed": a[i:x], "added": b[j:y]})
        i, j = x + 1, y + 1
    return out


def line_diff(old: Column, new: Column) -> Column:
    """The hunks (old_start, new_start, removed, added) between two versions of an artifact; null is empty."""
    kind = "array<struct<old_start:int,new_start:int,removed:array<string>,added:array<string>>>"

    @F.pandas_udf(kind)
    def diff(olds: pd.Series, news: pd.Series) -> pd.Series:
        return pd.Series([line_hunks(a or "", b or "") for a, b in zip(olds, news)])

    return diff(old, new)
