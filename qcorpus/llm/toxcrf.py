"""Toxic spans and document scores by a linear-chain conditional random field, in numpy.

Words (runs of letters, lower-cased) are tagged toxic or not. A word's emission is the sum of the
weights of its features, itself and its beginnings; transitions join neighbouring tags. Labels come
by document, so tokens are labelled first: a feature that toxic documents of the training sample
have far more often than the others marks a toxic token in a toxic document. The field is then
fitted to these tags by forward-backward over the whole sample.

A document is one chain, however long. To run many at once, chains are laid out in rows of
``SEQUENCE`` words; the product of a row's transitions carries the messages from row to row, so the
marginals are those of the whole chain. They add up to an expected number of toxic words. For the
score a power of theirs, which gives doubtful words little say, is summed and set against the
words of the text; a logistic curve, fitted with the labels' own shares, turns this into a probability. The power is the one of
``POWERS`` with which the curve fits the training documents best. Words whose marginal is at least a half give the offending offsets.

The training sample is bounded by rows and by the length of a row: of twice ``ROWS_PER_LABEL``
labelled ids the first ``ROWS_PER_LABEL`` documents of at most ``TRAIN_CHARS`` characters, for each
label. Scoring covers every text whole.

Defined cases: null and empty texts have no word and get the curve's value at zero; equal texts
get equal scores; with no labelled row, or labels of one kind, the score is that label's share (or
zero); an empty table stays empty; a caller's columns named as the added ones are replaced, all
others are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import byte_slices, draw, with_added

SEQUENCE = 128
ROWS_PER_LABEL = 1000
TRAIN_CHARS = 20_000
#: A feature marks toxic tokens if at least this share of toxic documents has it, so that what a
#: few copies of one document share does not.
MARK_SHARE = 0.015
#: A word counts for the score by one of these powers of its marginal, the one that fits the training documents' labels best.
POWERS = (1, 2, 4, 8)
_WORD = re.compile(r"[^\W\d_]+")
#: Words whose emissions a task remembers before it starts afresh.
_REMEMBER = 500_000


def features(word: str) -> list[str]:
    return [word + "$", *(word[:k] for k in (3, 4, 5, 6) if len(word) >= k)]


@dataclass
class Field:
    weights: dict[str, float]
    transition: np.ndarray  # log potential of (tag before, tag)
    start: np.ndarray
    curve: tuple[float, float]
    power: int = 1

    def emission(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word)) + self.weights.get("", 0.0)

    def score(self, certain: np.ndarray, words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * density(certain, words))))


def density(certain: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Toxic words among a thousand, on a logarithmic scale; a text counts as having 100 words more."""
    return np.log1p(1000 * certain / (words + 100))


def _share(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    return one / (zero + one)


def _messages(enter: np.ndarray, t: np.ndarray, gain: np.ndarray, inside: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What reaches each row from the rows before and after it in its chain, as shares of the toxic tag."""
    n, length = gain.shape
    m = np.stack([np.stack([enter[x, 0], enter[x, 1] * gain[:, 0]]) for x in (0, 1)])  # from tag, to tag, row
    for i in range(1, length):
        new = np.stack([np.stack([m[x, 0] * t[0, 0] + m[x, 1] * t[1, 0], (m[x, 0] * t[0, 1] + m[x, 1] * t[1, 1]) * gain[:, i]]) for x in (0, 1)])
        m = np.where(inside[:, i], new, m)
        m /= m.sum(axis=(0, 1))
    place = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    order = np.argsort(place, kind="stable")
    steps = np.split(order, np.cumsum(np.bincount(place))[:-1])[1:]  # the second rows of all chains, the third ones, ...
    before, after = np.full(n, 0.5), np.full(n, 0.5)
    for rows in steps:
        a, p = before[rows - 1], m[:, :, rows - 1]
        before[rows] = _share((1 - a) * p[0, 0] + a * p[1, 0], (1 - a) * p[0, 1] + a * p[1, 1])
    for rows in reversed(steps):
        a, p = after[rows], m[:, :, rows]
        after[rows - 1] = _share(p[0, 0] * (1 - a) + p[0, 1] * a, p[1, 0] * (1 - a) + p[1, 1] * a)
    return before, after


def forward_backward(
    emission: np.ndarray, inside: np.ndarray, transition: np.ndarray, start: np.ndarray, first: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic tag, and summed marginals of tag pairs, for sequences in the rows.

    A row that is not ``first`` goes on with the chain of the row before it, which is full.
    """
    t = np.exp(transition)
    gain = np.exp(np.clip(emission, -30, 30))
    n, length = emission.shape
    first = np.ones(n, bool) if first is None else first
    p = 1 / (1 + np.exp(start[0] - start[1]))
    enter = np.stack([np.stack([np.where(first, own, t[x, y]) for y, own in enumerate((1 - p, p))]) for x in (0, 1)])
    before, after = (np.full(n, 0.5), np.full(n, 0.5)) if first.all() else _messages(enter, t, gain, inside, first)
    ahead = np.empty((length, n))  # share of the toxic tag, given the words so far
    a = before
    for i in range(length):
        step = t if i else enter
        ahead[i] = np.where(inside[:, i], _share((1 - a) * step[0, 0] + a * step[1, 0], ((1 - a) * step[0, 1] + a * step[1, 1]) * gain[:, i]), a)
        a = ahead[i]
    marginal, pairs = np.empty((length, n)), np.zeros((2, 2))
    back = after
    for i in range(length - 1, -1, -1):
        marginal[i] = np.where(inside[:, i], _share((1 - ahead[i]) * (1 - back), ahead[i] * back), 0)
        own, rest = back * gain[:, i], 1 - back
        a = ahead[i - 1] if i else before
        joint = np.stack([(1 - a) * t[0, 0] * rest, (1 - a) * t[0, 1] * own, a * t[1, 0] * rest, a * t[1, 1] * own])
        counts = inside[:, i] if i else inside[:, i] & ~first
        pairs += np.where(counts, joint / joint.sum(axis=0), 0).sum(axis=1).reshape(2, 2)
        back = np.where(inside[:, i], _share(t[0, 1] * own + t[0, 0] * rest, t[1, 1] * own + t[1, 0] * rest), back)
    return marginal.T, pairs


def _sequences(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of SEQUENCE cells for documents of ``counts`` words: which cells hold one, the owner, where it begins."""
    rows = -(-counts // SEQUENCE)
    owner = np.repeat(np.arange(len(counts)), rows)
    first = np.cumsum(rows) - rows
    index = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    inside = np.zeros(len(owner) * SEQUENCE, bool)
    inside[np.repeat(first, counts) * SEQUENCE + index] = True
    begins = np.zeros(len(owner), bool)
    begins[first[rows > 0]] = True
    return inside.reshape(-1, SEQUENCE), owner, begins


def _words(text: str) -> list[str]:
    return _WORD.findall(text)


def train(texts: list[str], toxic: list[int], shares: tuple[float, float] = (0.5, 0.5), passes: int = 25) -> Field:
    """Label the tokens, fit the field to them and the curve to the documents.

    ``shares`` are those of both labels among all labelled documents.
    """
    texts, toxic = zip(*sorted(dict(zip(texts, toxic)).items()))  # copies count once
    split = [[w.lower() for w in _words(t)] for t in texts]
    total = [max(1, toxic.count(0)), max(1, toxic.count(1))]
    seen = [Counter(), Counter()]
    for found, y in zip(split, toxic):
        seen[y].update({f for w in set(found) for f in features(w)})
    least = max(4, MARK_SHARE * total[1])
    marks = {
        f for f, k in seen[1].items()
        if k >= least and math.log((k + 0.5) / total[1]) - math.log((seen[0][f] + 0.5) / total[0]) > 3
    }
    known = {f: i for i, f in enumerate(sorted(f for f in seen[0] | seen[1] if seen[0][f] + seen[1][f] >= 3))}
    # words by number; each has a few features, so a field's emissions are those of the distinct words
    numbers: dict[str, int] = {}
    flat = np.array([numbers.setdefault(w, len(numbers)) for found in split for w in found], np.int64)
    own = [[known[f] for f in features(w) if f in known] for w in numbers]
    word_of = np.repeat(np.arange(len(own)), [len(x) for x in own])
    feature_of = np.array([f for x in own for f in x], np.int64)
    is_mark = np.array([any(f in marks for f in features(w)) for w in numbers], bool)
    counts = np.array([len(found) for found in split], np.int64)
    inside, owner, begins = _sequences(counts)
    truth, word = np.zeros(inside.shape), np.zeros(inside.shape, np.int64)
    word[inside] = flat
    truth[inside] = is_mark[flat] & np.repeat(np.array(toxic, bool), counts)
    whole = truth.astype(int).ravel()
    linked = (inside & ~(begins[:, None] & (np.arange(SEQUENCE) == 0))).ravel()  # cells with a word before them in their chain
    ends = np.flatnonzero(linked)
    real = np.bincount(2 * whole[ends - 1] + whole[ends], minlength=4).reshape(2, 2).astype(float)
    weights, bias = np.zeros(len(known)), -2.0
    transition, start = np.zeros((2, 2)), np.zeros(2)
    square_w, square_b, square_t, square_s = np.full(len(known), 1e-6), 1e-6, np.full((2, 2), 1e-6), 1e-6
    chains = begins & inside[:, 0]  # the rows with a document's first word

    def emissions() -> np.ndarray:
        return np.bincount(word_of, weights=weights[feature_of], minlength=len(own)) + bias

    for _ in range(passes):
        marginal, pairs = forward_backward(np.where(inside, emissions()[word], 0), inside, transition, start, begins)
        error = truth[inside] - marginal[inside]
        by_word = np.bincount(flat, weights=error, minlength=len(own))
        grad = np.bincount(feature_of, weights=by_word[word_of], minlength=len(known)) - 0.01 * weights
        square_w += grad * grad
        weights += 0.5 * grad / np.sqrt(square_w)
        square_b += error.sum() ** 2
        bias += 0.5 * error.sum() / math.sqrt(square_b)
        change = real - pairs - 0.01 * transition
        square_t += change * change
        transition += 0.2 * change / np.sqrt(square_t)
        change = (truth[chains, 0] - marginal[chains, 0]).sum() - 0.01 * start[1]
        square_s += change * change
        start[1] += 0.2 * change / math.sqrt(square_s)  # that of the other tag stays zero: only their difference counts
    marginal, _ = forward_backward(np.where(inside, emissions()[word], 0), inside, transition, start, begins)
    y = np.array(toxic, float)
    weight = np.where(y == 1, shares[1] / total[1], shares[0] / total[0]) * len(y)
    found = []
    for power in POWERS:
        certain = density(np.bincount(owner, weights=(marginal**power).sum(axis=1), minlength=len(counts)), counts)
        curve = _curve(certain, y, weight)
        p = np.clip(1 / (1 + np.exp(-(curve[0] + curve[1] * certain))), 1e-9, 1 - 1e-9)
        found.append((-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum(), power, curve))
    _, power, curve = min(found)
    named = {f: float(weights[i]) for f, i in known.items() if weights[i]}
    return Field(named | {"": bias}, transition, start, curve, power)


def _curve(certain: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """A logistic curve through the documents' densities, by Newton's steps that a small ridge holds back."""
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a + b * certain)))
        error, v = weight * (y - p), weight * p * (1 - p)
        g = np.array([error.sum(), (error * certain).sum()]) - 0.05 * np.array([a, b])
        h = np.array([[v.sum(), (v * certain).sum()], [(v * certain).sum(), (v * certain**2).sum()]]) + 0.05 * np.eye(2)
        a, b = np.array([a, b]) + np.clip(np.linalg.solve(h, g), -2, 2)
    return float(a), float(b)


def marginals(field: Field, emissions: list[list[float]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each document the sums of its words' marginals and of their ``power``-th powers, and the marginals."""
    counts = np.array([len(e) for e in emissions], np.int64)
    if not counts.sum():
        return np.zeros(len(counts)), np.zeros(len(counts)), [np.zeros(0)] * len(counts)
    inside, owner, begins = _sequences(counts)
    table = np.zeros(inside.shape)
    table[inside] = np.fromiter((x for e in emissions for x in e), np.float64, int(counts.sum()))
    marginal, _ = forward_backward(table, inside, field.transition, field.start, begins)
    total = [np.bincount(owner, weights=m.sum(axis=1), minlength=len(counts)) for m in (marginal, marginal**field.power)]
    return *total, np.split(marginal[inside], np.cumsum(counts)[:-1])


def draw_labels(labels: DataFrame, id_col="doc_id", label_col="toxic") -> DataFrame:
    """Labelled ids drawn by hash, 2 * ROWS_PER_LABEL of each label: few enough to broadcast to the texts."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(id_col, label_col).distinct()
    return draw(rows, label_col, id_col, 2 * ROWS_PER_LABEL)


def training_rows(df: DataFrame, text_col="text", label_col="toxic", key: Column | None = None) -> DataFrame:
    text = F.col(text_col)
    key = F.xxhash64(text) if key is None else key
    rows = df.where(F.col(label_col).isin(0, 1) & text.isNotNull() & (F.length(text) <= TRAIN_CHARS))
    rows = rows.select(F.col(label_col).cast("int").alias("label"), key.alias("key"), text.alias("text"))
    number = F.row_number().over(W.partitionBy("label").orderBy("key", "text"))
    return rows.withColumn("n", number).where(F.col("n") <= ROWS_PER_LABEL).select("text", "label")


def fit(df: DataFrame, text_col="text", label_col="toxic", key: Column | None = None, shares: tuple[float, float] | None = None) -> Field:
    """``shares`` are the labels' counts or shares; those of ``df`` if it holds all labelled documents."""
    rows = training_rows(df, text_col, label_col, key).collect()  # bounded: ROWS_PER_LABEL short texts of each
    rows = sorted(rows, key=lambda r: (r["label"], r["text"]))
    labels = [r["label"] for r in rows]
    if len(set(labels)) < 2:
        return Field({}, np.zeros((2, 2)), np.array([30.0, -30.0]), (30.0 if labels[:1] == [1] else -30.0, 0.0))
    both = shares or label_counts(df, label_col)
    return train([r["text"] for r in rows], labels, (both[0] / sum(both), both[1] / sum(both)))


def label_counts(labels: DataFrame, label_col="toxic") -> tuple[int, int]:
    found = {int(r[0]): r[1] for r in labels.where(F.col(label_col).isin(0, 1)).groupBy(label_col).count().collect()}
    return found.get(0, 1), found.get(1, 1)


def _score(batches: Iterator[pa.RecordBatch], field: Field, text_col: str, stay: list[str], spans: bool) -> Iterator[pa.RecordBatch]:
    cache: dict[str, float] = {}
    for batch in batches:
        for part in byte_slices([batch], text_col, 2 << 20):
            texts = [x.as_py() or "" for x in part.column(text_col)]
            emissions = []
            if len(cache) > _REMEMBER:
                cache.clear()
            for text in texts:
                found = _words(text)
                for w in set(filterfalse(cache.__contains__, found)):
                    cache[w] = field.emission(w.lower())
                emissions.append(list(map(cache.__getitem__, found)))
            expected, certain, own = marginals(field, emissions)
            columns = [part.column(c) for c in stay] + [pa.array(field.score(certain, np.array([len(m) for m in own], np.int64))), pa.array(expected)]
            names = [*stay, "toxic_score", "toxic_words"]
            if spans:
                columns.append(pa.array([_offsets(t, m) for t, m in zip(texts, own)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
                names.append("toxic_spans")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _offsets(text: str, marginal: np.ndarray) -> list[dict[str, int]]:
    """Code-point offsets of the runs of words whose marginal is at least a half."""
    hits = np.flatnonzero(marginal >= 0.5).tolist()
    if not hits:
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    out: list[dict[str, int]] = []
    for i in hits:
        if out and out[-1]["end"] == places[i - 1][1]:
            out[-1]["end"] = places[i][1]
        else:
            out.append({"start": places[i][0], "end": places[i][1]})
    return out


def score(df: DataFrame, field: Field, text_col="text", spans: bool = True, keep_text: bool = True) -> DataFrame:
    """Add ``toxic_score``, the expected ``toxic_words`` and, if asked for, the ``toxic_spans``."""
    added = "toxic_score double, toxic_words double" + ", toxic_spans array<struct<start:long,end:long>>" * spans
    rows, stay, out = with_added(df.drop(*{"toxic_spans"} - {text_col}), text_col, keep_text, added)
    return rows.mapInArrow(lambda batches: _score(batches, field, text_col, stay, spans), out)
