"""Normalisation, hashing and trigrams of question texts, as built-in column expressions."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java character class of what Python's str.split() takes as white space.
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]+"


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """NFC form. Below U+0300 a text is its own NFC form, so only others are sent to Python."""
    return F.coalesce(_nfc(F.when(text.rlike(r"[^\x{0}-\x{2ff}]"), text)), text)


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def plain_forms(text: Column) -> Column:
    """NFKC form, in which full-width and mathematical letters are plain ones; an ASCII text is its own and stays in the JVM."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


#: Parts of the names of fonts that code is set in.
CODE_FONTS = ("courier", "consolas", "mono")


def font_family(font: Column) -> Column:
    """A font's name in lower case, without spaces and the prefix of a subset."""
    return F.lower(F.replace(F.regexp_replace(F.coalesce(font, F.lit("")), r"^[^+]*\+", ""), F.lit(" "), F.lit("")))


def normalize_text(text: Column, compose: bool = True) -> Column:
    """NFC, lower case, white space to single spaces, then only letters, marks, digits and spaces.

    White space is collapsed before marks are dropped, so a lone dash leaves two spaces.
    """
    text = nfc(text) if compose else text
    spaced = F.trim(F.regexp_replace(F.lower(text), SPACE, " "))
    return F.trim(F.regexp_replace(spaced, r"[^\p{L}\p{M}\p{N}\s]", ""))


def _hashes(texts: list[str]) -> list[str]:
    """The djb2-xor hash of the code points, modulo 2**32, in lower-case base 36.

    All texts take a step at a time, the longest first, so that a step is one operation on an array.
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    points = np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le"), np.uint32)
    starts = np.cumsum(sizes) - sizes
    state = np.full(len(texts), 5381, np.uint32)
    busy = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), "right")  # texts of a length at least
    steps = int(np.searchsorted(-busy, -_FEW, "right")) if len(busy) else 0
    for i in range(steps):
        k = busy[i]
        state[:k] = state[:k] * np.uint32(33) ^ points[starts[:k] + i]
    for r in range(int(np.searchsorted(-sizes, -steps, "left"))):  # the few that are longer
        value = int(state[r])
        for c in points[starts[r] + steps : starts[r] + sizes[r]].tolist():
            value = value * 33 & 0xFFFFFFFF ^ c
        state[r] = value
    out = [""] * len(texts)
    for i, value in zip(order, state.tolist()):
        out[i] = np.base_repr(value, 36).lower()
    return out


#: So few texts at a time are hashed one by one.
_FEW = 24


@F.pandas_udf(T.StringType())
def content_hash(normalized: pd.Series) -> pd.Series:
    known = normalized.notna()
    out = pd.Series([None] * len(normalized), dtype=object)
    out[known.to_numpy()] = _hashes(normalized[known].tolist())
    return out


def text_digest(normalized: Column) -> Column:
    """SHA-256 of a text: what equal texts are grouped by, so that texts themselves are not shuffled."""
    return F.unhex(F.sha2(normalized.cast("binary"), 256))


#: The number words that count as numbers in a question.
NUMBER_WORDS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve",
    "first", "second", "third", "fourth", "fifth", "single", "double", "triple", "once", "twice",
)


def numbers_in(normalized: Column) -> Column:
    """Digit tokens and number words, in order."""
    words = F.split(normalized, r"\s+")
    return F.filter(words, lambda w: w.rlike(r"^\p{Nd}+$") | w.isin(*NUMBER_WORDS))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-case words, each led by two spaces and closed by one."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def edit_similarity(a: Column, b: Column) -> Column:
    """One minus the edit distance over the longer length; two empty texts are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def could_reach(len_a: Column, len_b: Column, threshold: float) -> Column:
    return F.least(len_a, len_b) >= F.greatest(len_a, len_b) * threshold


def excerpt(text: Column, characters: int = 200) -> Column:
    return F.left(text, F.lit(characters))


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def humanize(slug: Column) -> Column:
    return F.initcap(F.translate(slug, "-_", "  "))


def strip_boilerplate(text: Column, lines: tuple[str, ...]) -> Column:
    """An explanation's lines but those that begin with one of ``lines``, with no two blank ones in a row; null if nothing, or a lone heading, is left."""
    whole = F.transform(F.split(text, "\n"), lambda line: F.rtrim(line, F.lit(" \t")))
    starts = [F.lower(F.lit(x)) for x in lines]

    def crawled(line: Column) -> Column:
        own, found = F.lower(F.ltrim(line, F.lit(" \t"))), F.lit(False)
        for x in starts:  # and ends there, or goes on with another word
            found = found | (F.startswith(own, x) & ~F.substr(own, F.length(x) + 1, F.lit(1)).rlike(r"\w"))
        return found

    kept = F.filter(whole, lambda line: ~crawled(line))
    kept = F.filter(kept, lambda line, i: (line != "") | (F.coalesce(F.get(kept, i - 1), F.lit("")) != ""))
    left = F.trim(F.array_join(kept, "\n"), F.lit(" \t\n\r"))
    return F.when(~F.lower(left).isin("", "rationale:"), left)


def labelled_section(text: Column, label: str, stops: tuple[str, ...]) -> Column:
    """What follows ``label:`` up to the next of ``stops`` or the end."""
    end = "|".join(rf"\b{s}\s*:" for s in stops)
    return F.trim(F.regexp_extract(text, rf"(?is)\b{label}\s*:\s*(.*?)(?={end}|\z)" if end else rf"(?is)\b{label}\s*:\s*(.*)\z", 1))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def host_matches(name: Column, suffix: Column) -> Column:
    """The host is ``suffix`` or one of its subdomains."""
    return (name == suffix) | F.endswith(name, F.concat(F.lit("."), suffix))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def key_list(keys: Column) -> Column:
    """"A", "A and B", "A, B and D"."""
    n = F.size(keys)
    head = F.array_join(F.slice(keys, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, F.lit("")).when(n == 1, F.get(keys, F.lit(0))).otherwise(F.concat(head, F.lit(" and "), F.get(keys, n - 1)))
