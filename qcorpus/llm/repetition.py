"""Quality rule on repetition inside a document, by suffix array and longest-common-prefix intervals.

The words of many documents are numbered, with numbers that no two documents share, and their
suffixes are sorted by prefix doubling; only suffixes that still tie are sorted again. The ranks
after each doubling give the longest common prefix of neighbouring suffixes. A suffix's longest
repeat is the larger prefix it shares with its neighbours, that is the value of the deepest LCP
interval that holds it; the spans of all repeats of at least ``min_words`` words are united. The
rule limits the share of characters that the union covers and the longest repeat.

Defined cases: null and empty texts have no word and no repeat; ties need no order, as only
lengths are used; a text of any length is one suffix array, in memory linear in its words;
repeated rows are judged alike; an empty table stays empty; a caller's columns named as the measures
are replaced, all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, raw_texts, with_added

#: A repeat counts from so many words.
MIN_WORDS = 8
#: Largest share of characters that repeats may cover, and longest repeat in words.
MAX_COVERED = 0.2
MAX_LONGEST = 100


def longest_repeats(symbols: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring from there that its document repeats.

    ``docs`` numbers the documents in ascending order; a repeat stays within its document.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    ends = np.searchsorted(docs, docs, side="right")
    _, word = np.unique(symbols, return_inverse=True)
    # a rank is the number of suffixes that sort below, so that a tie can be split on its own
    rank = _ranks(docs * n + word)
    levels, length = [rank], 1
    tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while len(tied):
        after = tied + length
        follow = np.where(after < ends[tied], rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[tied].astype(np.int64) * (n + 1) + follow
        finer = rank.copy()
        finer[tied] = rank[tied] + _ranks(key) - _ranks(rank[tied])
        rank = finer
        levels.append(rank)
        length *= 2
        tied = tied[np.bincount(rank[tied], minlength=n)[rank[tied]] > 1]
    suffixes = np.argsort(rank)
    a, b = suffixes[:-1].copy(), suffixes[1:].copy()
    end_a, end_b = ends[a], ends[b]
    lcp = np.zeros(n - 1, np.int64)
    live = np.flatnonzero(docs[a] == docs[b])
    for k in range(len(levels) - 1, -1, -1):
        i = live[(a[live] < end_a[live]) & (b[live] < end_b[live])]
        i = i[levels[k][a[i]] == levels[k][b[i]]]
        lcp[i] += 1 << k
        a[i] += 1 << k
        b[i] += 1 << k
    best = np.zeros(n, np.int64)
    best[suffixes[1:]] = lcp
    best[suffixes[:-1]] = np.maximum(best[suffixes[:-1]], lcp)
    return best


def _ranks(keys: np.ndarray) -> np.ndarray:
    """For each key, the number of smaller ones."""
    order = np.argsort(keys)
    ordered = keys[order]
    place = np.arange(len(keys), dtype=np.int32)
    place[1:][ordered[1:] == ordered[:-1]] = 0
    ranks = np.empty(len(keys), np.int32)
    ranks[order] = np.maximum.accumulate(place)
    return ranks


def covered(best: np.ndarray, min_words: int) -> np.ndarray:
    """Which positions the repeats of at least ``min_words`` words cover."""
    at = np.flatnonzero(best >= min_words)
    steps = np.zeros(len(best) + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + best[at], -1)
    return np.cumsum(steps[:-1]) > 0


def _measure(texts: list[bytes], min_words: int) -> list[list[int]]:
    """Per text: words, their characters, words and characters covered by repeats, longest repeat."""
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split])
    total = int(sizes.sum())
    numbers: dict[bytes, int] = {}
    symbols = np.fromiter((numbers.setdefault(w, len(numbers)) for words in split for w in words), np.int64, total)
    chars = np.fromiter((len(w) if w.isascii() else len(w.decode()) for words in split for w in words), np.int64, total)
    docs = np.repeat(np.arange(len(texts)), sizes)
    best = longest_repeats(symbols, docs)
    inside = covered(best, min_words)
    add = lambda x: np.bincount(docs, weights=x, minlength=len(texts)).astype(np.int64)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, docs, best)
    return [sizes.astype(np.int64), add(chars), add(inside), add(chars * inside), longest]


_MEASURES = "n_words long, word_chars long, n_repeat_words long, repeat_chars long, longest_repeat long"


def _measures(batches: Iterator[pa.RecordBatch], text_col: str, stay: list[str], min_words: int) -> Iterator[pa.RecordBatch]:
    names = [*stay, *(x.split()[0] for x in _MEASURES.split(", "))]
    for batch in batches:
        for part in byte_slices([batch], text_col, 2 << 20):
            found = _measure(raw_texts(part.column(text_col)), min_words)
            yield pa.RecordBatch.from_arrays([part.column(c) for c in stay] + [pa.array(x) for x in found], names=names)


def repetition(
    df: DataFrame, text_col="text", min_words=MIN_WORDS, max_covered=MAX_COVERED, max_longest=MAX_LONGEST, keep_text=True,
) -> DataFrame:
    """Add the measures and ``repetitive``: repeats cover too much, or one is too long."""
    rows, stay, out = with_added(df.drop(*{"repetitive"} - {text_col}), text_col, keep_text, _MEASURES)
    found = rows.mapInArrow(lambda batches: _measures(batches, text_col, stay, min_words), out)
    much = F.col("repeat_chars") > max_covered * F.col("word_chars")
    return found.withColumn("repetitive", much | (F.col("longest_repeat") > max_longest))


def with_line_counts(df: DataFrame, text_col="text") -> DataFrame:
    """Add ``n_symbols`` and ``n_dup_lines``, by built-in functions."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "")
    return df.withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long")).withColumn(
        "n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")
    )
