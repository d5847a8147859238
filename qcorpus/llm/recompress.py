"""Removal of repeated word sequences by recompression.

Recompression (Jez, 2013) parses a text in rounds that depend on nothing but the symbols next to
each other: runs of a symbol are named, then symbols are split into left and right ones and each
left-right pair is named. Names are hashes of what they stand for, so every document of the corpus
gets the same name for the same content without a dictionary, and equal substrings get equal
symbols but for their ends.

Spark compares the symbols of all documents in two levels:

* Low symbols, of about three words. For each the parse also tracks the context that forced it. A
  window of ``window`` words that holds a symbol with its context has that symbol wherever the
  window occurs, so a window with a symbol that occurs once in the corpus is unique. The longest
  such symbol stands for the window; windows that hold none stand for themselves.
* Pairs of high symbols, of about forty words. A pair that an earlier document has too, or that
  stands earlier in its own, is a long repeat: every window inside it starts earlier.

What is left are windows of which every low symbol is shared and which no long repeat holds. The
first occurrence of a window is never inside a long repeat's later copies, so comparing just these
windows is exact. Pairs and windows are verified by a second hash of the words that they span, made of
names that another hash function gives to the words: two that are taken for equal across documents agree in 96 bits, 64 of
the name and 32 of the second hash; within a document they agree in 64 bits that are made of both.
Low symbols only sift, so 64 bits do there. Tables of symbols are combined before they are
shuffled, and texts are compressed before they meet their symbols; a symbol that a third of all documents hold is one row per document there, and joins meet
it with a table of one row for each symbol, which Spark can split. The last step gets the places to
cut and parses nothing.

Defined cases: null and empty texts have no word and lose nothing; texts shorter than the window
lose nothing; rows are documents of their own, ordered by id, null last, then by a hash of the text,
so of rows that share an id and a text one keeps it; a caller's columns named as those that are
added are replaced, all others are kept by :func:`remove_repeats`; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, drop_path, raw_texts, staged, stored

WINDOW = 20
#: Rounds of pairing up to the low and the high symbols; a round makes them a third longer.
LOW_ROUNDS, HIGH_ROUNDS = 4, 10
#: Bytes of text that are parsed at a time; a parse takes some hundred bytes a word.
_SLICE = 1 << 20
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_A_INVERSE = np.uint64(pow(int(_A), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Parse:
    """Symbols of the words of several documents: names, word spans and forcing contexts."""

    def __init__(self, names: np.ndarray, docs: np.ndarray):
        self.names, self.docs = names, docs
        self.start = np.arange(len(names))
        self.end = self.start + 1
        self.low, self.high = self.start, self.end  # the context

    def _keep(self, first: np.ndarray, last: np.ndarray, names: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.names, self.docs = names, self.docs[first]
        self.start, self.end = self.start[first], self.end[last]
        self.low, self.high = low, high

    def name_runs(self) -> None:
        n = len(self.names)
        if n < 2:
            return
        joined = (self.names[1:] == self.names[:-1]) & (self.docs[1:] == self.docs[:-1])
        first = np.flatnonzero(np.concatenate(([True], ~joined)))
        last = np.concatenate((first[1:], [n])) - 1
        size = (last - first + 1).astype(np.uint64)
        names = self.names[first]
        names = np.where(size > 1, _mix(names * _A + size * _B + _C), names)
        # that a run ends is forced by its neighbours; before the first word there is none
        left, right = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
        low = np.where((first > 0) & (self.docs[left] == self.docs[first]), self.low[left], self.start[first] - 1)
        high = np.where((last < n - 1) & (self.docs[right] == self.docs[last]), self.high[right], self.end[last] + 1)
        self._keep(first, last, names, np.minimum(low, self.low[first]), np.maximum(high, self.high[last]))

    def name_pairs(self, salt: int) -> None:
        n = len(self.names)
        if n < 2:
            return
        right = (_mix(self.names ^ np.uint64(int(_A) * (2 * salt + 1) % (1 << 64))) & np.uint64(1)).astype(bool)
        same = self.docs[1:] == self.docs[:-1]
        paired = ~right[:-1] & right[1:] & same
        second = np.concatenate(([False], paired))
        first = np.flatnonzero(~second)
        is_pair = np.concatenate((paired, [False]))[first]
        last = first + is_pair
        names = np.where(is_pair, _mix(self.names[first] * _A + _mix(self.names[last] + _C) * _B), self.names[first])
        # a pair needs no more than its halves; a symbol stays alone because of the neighbour it
        # might have joined, a left one's right and a right one's left
        low, high = self.low[first].copy(), self.high[last].copy()
        alone = np.flatnonzero(~is_pair)
        at = first[alone]
        after, before = np.minimum(at + 1, n - 1), np.maximum(at - 1, 0)
        goes_left = right[at]
        has_before = (at > 0) & (self.docs[before] == self.docs[at])
        has_after = (at < n - 1) & (self.docs[after] == self.docs[at])
        low[alone] = np.where(goes_left, np.minimum(low[alone], np.where(has_before, self.low[before], self.start[at] - 1)), low[alone])
        high[alone] = np.where(goes_left, high[alone], np.maximum(high[alone], np.where(has_after, self.high[after], self.end[at] + 1)))
        both = goes_left & has_before
        high[alone[both]] = np.maximum(high[alone[both]], self.high[before[both]])
        both = ~goes_left & has_after
        low[alone[both]] = np.minimum(low[alone[both]], self.low[after[both]])
        low[is_pair] = np.minimum(self.low[first[is_pair]], self.low[last[is_pair]])
        high[is_pair] = np.maximum(self.high[first[is_pair]], self.high[last[is_pair]])
        self._keep(first, last, names, low, high)


def word_names(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' names, their names by another hash function, and their documents."""
    split = [t.split() for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    names, others = (np.fromiter((h for words in split for h in map(f, words)), np.uint64, int(counts.sum())) for f in (xxhash.xxh64_intdigest, xxhash.xxh3_64_intdigest))
    return names, others, np.repeat(np.arange(len(texts)), counts)


def window_hashes(names: np.ndarray, docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window from each position, and whether it ends in the same document."""
    n = len(names)
    out = np.zeros(n, np.uint64)
    if n < window:
        return out, np.zeros(n, bool)
    whole = np.zeros(n, bool)
    whole[: n - window + 1] = docs[window - 1 :] == docs[: n - window + 1]
    # by doubling: the hash of 2k words is that of two times k
    step, made, have = names, None, 0
    size, bit = 1, window
    while bit:
        if bit & 1:
            if made is None:
                made, have = step, size
            else:
                m = n - have - size + 1
                made, have = _mix(made[:m] * _A + step[have : have + m] * _B + np.uint64(size)), have + size
        bit >>= 1
        if bit:
            m = len(step) - size
            if m <= 0:
                break
            step, size = _mix(step[:m] * _A + step[size : size + m] * _B + np.uint64(size)), 2 * size
    out[: n - window + 1] = made[: n - window + 1]
    return out, whole


class SpanChecks:
    """Second hashes, of 32 bits, of spans of words: a polynomial over the words' other names, by prefix sums."""

    def __init__(self, names: np.ndarray):
        power = lambda x: np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(len(names), x))))
        self.down = power(_A_INVERSE)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(names ^ _C) * power(_A)[:-1])))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (_mix((self.sums[end] - self.sums[start]) * self.down[start]) >> np.uint64(32)).astype(np.int64)


def _symbols(names: np.ndarray, others: np.ndarray, docs: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """For each window the symbol that stands for it, and the pairs of high symbols.

    ``key``, ``hash`` and ``whole`` go by the window's first word; keys are even for low symbols
    and odd for pairs. Of the low symbols that a window forces the longest stands for it.
    """
    hashes, whole = window_hashes(names, docs, window)
    p = Parse(names, docs)
    p.name_runs()
    for r in range(LOW_ROUNDS):
        p.name_pairs(r)
    inside = np.flatnonzero(p.high - p.low <= window)
    low, high = p.low[inside], p.high[inside]  # both ascend
    size = (p.end - p.start)[inside]
    value = _mix(p.names[inside] ^ _B)
    place = np.arange(len(names))
    first, last = np.searchsorted(low, place), np.searchsorted(high, place + window, "right")
    best = np.full(len(names), -1)
    for j in range(int((last - first).max(initial=0))):
        at = np.flatnonzero(first + j < last)
        new, old = first[at] + j, best[at]
        better = (old < 0) | (size[new] > size[old]) | (size[new] == size[old]) & (value[new] < value[old])
        best[at[better]] = new[better]
    key = np.where(best >= 0, value[np.maximum(best, 0)] if len(value) else 0, _mix(hashes ^ _C)) & ~np.uint64(1)
    for r in range(LOW_ROUNDS, HIGH_ROUNDS):
        p.name_runs()
        p.name_pairs(r)
    pairs = np.flatnonzero((p.docs[1:] == p.docs[:-1]) & (p.end[1:] - p.start[:-1] >= window))
    named = _mix(p.names[pairs] * _B + _mix(p.names[pairs + 1] ^ _C) * _A) | np.uint64(1)
    checks = SpanChecks(others)
    return {
        "key": key, "hash": hashes, "whole": whole, "pair": named, "pair_check": checks.of(p.start[pairs], p.end[pairs + 1]), "checks": checks,
        "pair_start": p.start[pairs], "pair_end": p.end[pairs + 1], "pair_doc": p.docs[pairs],
    }


def _of(docs: np.ndarray, keys: np.ndarray, checks: np.ndarray | None = None) -> np.ndarray:
    """One number for a key in a document of the batch, and for its check if there is one."""
    marks = keys if checks is None else _mix(keys + _C) ^ _mix(checks.astype(np.uint64) * _B)
    return _mix(marks * _A + docs.astype(np.uint64) * _B)


def _later(marks: np.ndarray) -> np.ndarray:
    """Which of ``marks`` stand further on than an equal one."""
    _, first = np.unique(marks, return_index=True)
    later = np.ones(len(marks), bool)
    later[first] = False
    return later


def _once(docs: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """A place of each key of a document, and two of one that it has more than once."""
    _, first, counts = np.unique(_of(docs, keys, checks), return_index=True, return_counts=True)
    return np.sort(np.concatenate((first, first[counts > 1])))


def _batch(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names=names.split())


def _emit_symbols(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(key, check, place); a key that a document has more than once gives two rows."""
    for batch in batches:
        for part in byte_slices([batch], "text", _SLICE):
            ids, texts = part.column("_place").to_numpy(), raw_texts(part.column("text"))
            names, others, docs = word_names(texts)
            s = _symbols(names, others, docs, window)
            at = np.flatnonzero(s["whole"])
            # neighbouring windows mostly share the symbol that stands for them: one row for it
            keys, owner = s["key"][at], docs[at]
            new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1))) if len(at) else at.astype(bool)
            twice = np.flatnonzero(_later(_of(docs[at], s["hash"][at], s["checks"].of(at, at + window))))  # repeats inside the document
            keys = np.concatenate((keys[new], s["key"][at][twice], s["pair"]))
            owner = np.concatenate((owner[new], owner[twice], s["pair_doc"]))
            checks = np.zeros(len(keys), np.int64)
            checks[len(keys) - len(s["pair"]) :] = s["pair_check"]
            some = _once(owner, keys, checks)
            yield _batch("key check place", keys[some], checks[some], ids[owner[some]])


def _inside(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of n places some range [first, last) holds."""
    steps = np.zeros(n + 1, np.int64)
    ok = last > first
    np.add.at(steps, first[ok], 1)
    np.add.at(steps, last[ok], -1)
    return np.cumsum(steps[:-1]) > 0


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values, np.repeat(np.arange(len(column)), pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))


def _compress(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    """The texts as zstd frames, which are smaller than what the shuffle's own compression makes of them."""
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for part in byte_slices([batch], text_col):
            at = part.schema.get_field_index(text_col)
            texts = [None if x is None else packer.compress(x) for x in part.column(text_col).cast(pa.binary()).to_pylist()]
            yield part.set_column(at, text_col, pa.array(texts, pa.binary()))


def _compressed(df: DataFrame, text_col: str) -> DataFrame:
    out = ", ".join(f"`{f.name}` {'binary' if f.name == text_col else f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(lambda batches: _compress(batches, text_col), out)


def _unpacked(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with their texts, about ``max_bytes`` of text in each by what the frames say of their content, one row at least."""
    unpacker = zstandard.ZstdDecompressor()
    frames = batch.column(column).to_pylist()
    sizes = np.array([0 if x is None else zstandard.frame_content_size(x) for x in frames], np.int64)
    part = np.cumsum(sizes + 1) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(frames)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a), [b"" if x is None else unpacker.decompress(x) for x in frames[a:b]]


def _emit_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(key, tag, place): windows to compare, and without a key spans that are known to be repeats.

    A window's tag is its check and its place in the text, a span's its length and its place.
    """
    for batch in batches:
        for part, texts in _unpacked(batch, "text", _SLICE // 2):
            ids = part.column("_place").to_numpy()
            names, others, docs = word_names(texts)
            s = _symbols(names, others, docs, window)
            origin = np.searchsorted(docs, docs)  # where a word's document begins
            flags, flag_docs = _flat(part.column("flags"))
            flag_checks, _ = _flat(part.column("flag_checks"))
            flags = flags.view(np.uint64)
            odd = (flags & np.uint64(1)).astype(bool)
            own = _of(s["pair_doc"], s["pair"], s["pair_check"])
            repeated = np.isin(own, _of(flag_docs[odd], flags[odd], flag_checks[odd])) | _later(own)
            start, end = s["pair_start"][repeated], s["pair_end"][repeated]
            held = _inside(len(names), start, end - window + 1)
            at = np.flatnonzero(s["whole"] & ~held & np.isin(s["key"], flags))
            again = _later(_of(docs[at], s["hash"][at], s["checks"].of(at, at + window)))
            gone = _inside(len(names), np.concatenate((start, at[again])), np.concatenate((end, at[again] + window)))
            at = at[~again]
            yield _batch(
                "key tag place", s["hash"][at], (s["checks"].of(at, at + window) << 32) | (at - origin[at]), ids[docs[at]]
            )
            # runs of words that go, within their documents
            breaks = np.concatenate(([True], (gone[1:] != gone[:-1]) | (docs[1:] != docs[:-1]), [True])) if len(gone) else gone
            edges = np.flatnonzero(breaks)
            start, size = edges[:-1], np.diff(edges)
            start, size = start[gone[start]], size[gone[start]]
            if len(start):
                spans = _batch("tag place", (size << 32) | (start - origin[start]), ids[docs[start]])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(start), pa.int64()), *spans.columns], names=["key", "tag", "place"])


def _cut(batches: Iterator[pa.RecordBatch], text_col: str, keep_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in _unpacked(batch, text_col, _SLICE):
            split = [t.split() for t in texts]
            counts = np.array([len(w) for w in split], np.int64)
            first = np.cumsum(counts) - counts
            spans, owner = _flat(part.column("_spans"))
            start = first[owner] + (spans & 0xFFFFFFFF)
            gone = _inside(int(counts.sum()), start, start + (spans >> 32))
            removed = np.add.reduceat(np.append(gone, False), first, dtype=np.int64) * (counts > 0) if len(texts) else counts
            kept = []
            for words, at, n in zip(split, first.tolist(), removed.tolist()):
                if n:
                    words = compress(words, (~gone[at : at + len(words)]).tolist())
                kept.append(b" ".join(words))
            columns = {c: part.column(c) for c in part.schema.names if c != "_spans"}
            if keep_text:
                own = [None if null else t for t, null in zip(texts, part.column(text_col).is_null().to_pylist())]
                columns[text_col] = pa.array([k if r else t for k, t, r in zip(kept, own, removed.tolist())], pa.binary()).cast(pa.string())
            else:
                del columns[text_col]
            columns |= {
                "n_words": pa.array(counts), "n_removed": pa.array(removed),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _shared(rows: DataFrame) -> DataFrame:
    """Keys that occur twice or more, with the first document."""
    return rows.groupBy("key", "check").agg(F.count("*").alias("n"), F.min("place").alias("first_place")).where("n > 1").drop("n")


def _with_place(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Add ``_place``, which orders rows by id: the id itself, if each row has one of its own."""
    ids = df.select(F.col(id_col).cast("long").alias("id"))
    if not ids.groupBy("id").agg(F.count("*").alias("n")).where("id is null or n > 1").head(1):
        return df.withColumn("_place", F.col(id_col).cast("long"))
    order = [F.col(id_col).cast("long").asc_nulls_last(), F.xxhash64(text_col)]
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(rows.withColumn("_place", F.monotonically_increasing_id()), "ordered")


def remove_repeats(df: DataFrame, id_col="doc_id", text_col="text", window=WINDOW, keep_text=True) -> DataFrame:
    """Cut every word inside a window that also starts earlier; what is left is joined by single spaces.

    Texts that lose nothing stay as they are. Adds ``n_words``, ``n_removed`` and ``kept_sha256`` (of the
    words left, joined by single spaces). Without ``keep_text`` the text column is dropped instead.
    """
    added = ["n_words", "n_removed", "kept_sha256", "_place", "_of", "_spans"]
    rows = _with_place(df.drop(*[c for c in added if c not in (id_col, text_col)]), id_col, text_col)
    texts = rows.select("_place", F.col(text_col).alias("text"))
    symbols, symbols_path = stored(texts.mapInArrow(lambda b: _emit_symbols(b, window), "key long, check long, place long"), "symbols")
    found = symbols.join(_shared(symbols), ["key", "check"]).where("key % 2 = 0 or place > first_place")
    flags = found.groupBy("place").agg(F.collect_set(F.struct("key", "check")).alias("f"))
    flags = flags.select("place", F.col("f.key").alias("flags"), F.col("f.check").alias("flag_checks"))
    some = _compressed(texts, "text").join(flags, F.col("_place") == F.col("place")).select("_place", "text", "flags", "flag_checks")
    found = staged(some.mapInArrow(lambda b: _emit_windows(b, window), "key long, tag long, place long"), "windows")
    drop_path(df.sparkSession, symbols_path)
    windows = found.where("key is not null").select("key", F.shiftright("tag", 32).alias("check"), "place", "tag")
    later = windows.join(_shared(windows), ["key", "check"]).where("place > first_place")
    later = later.select("place", F.col("tag").bitwiseAND(0xFFFFFFFF).bitwiseOR(window << 32).alias("span"))
    spans = later.unionByName(found.where("key is null").select("place", F.col("tag").alias("span")))
    spans = spans.groupBy(F.col("place").alias("_of")).agg(F.collect_list("span").alias("_spans"))
    names = [c for c in rows.columns if c != "_place"]
    marked = _compressed(rows, text_col).join(spans, F.col("_place") == F.col("_of"), "left").select(*names, "_spans")
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names and (keep_text or f.name != text_col))
    out += ", n_words long, n_removed long, kept_sha256 string"
    return marked.mapInArrow(lambda b: _cut(b, text_col, keep_text), out)
