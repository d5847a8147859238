"""Language identification by a byte convolutional network, in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter's
largest answer over the window is kept, and a softmax layer turns these into probabilities. The
network is trained on the driver on a bounded sample of labelled windows, of equal size per
language; it is then applied to every window of every text, in batches, and a text's score is the
mean over its windows, weighted by the bytes in each.

Defined cases: null texts and texts without a letter are ``und`` with score 0; the last window is
padded with spaces; equal texts get equal scores; with no labelled row at all everything is
``und``; an empty table stays empty; a caller's ``lang_pred`` and ``lang_score`` are replaced, all
other columns are kept. Letters are those of Unicode's category L. Of labels beyond the 256 that have
the most rows none is learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, draw, raw_texts, with_added

WINDOW = 256
WIDTHS = (2, 3, 4)
EMBED, FILTERS = 8, 8
#: Most labelled rows of a language that are sampled for training.
ROWS_PER_LANGUAGE = 1500
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # widest * EMBED x filters; a narrow filter has zeros past its width
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter answers at every place of the uint8 ``windows``, and the columns they came from."""
        span = max(WIDTHS)
        x = self.embed[windows]
        columns = np.lib.stride_tricks.sliding_window_view(x.reshape(len(x), -1), span * EMBED, axis=1)[:, ::EMBED]
        return columns @ self.filters, columns

    def logits(self, windows: np.ndarray) -> np.ndarray:
        answers, _ = self.pooled(windows)
        return np.maximum(answers.max(axis=1) + self.bias, 0) @ self.dense + self.dense_bias


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _mask() -> np.ndarray:
    span = max(WIDTHS)
    return np.concatenate([np.repeat(np.arange(span)[:, None] < w, FILTERS, axis=1) for w in WIDTHS], axis=1).repeat(EMBED, axis=0)


def train(texts: list[bytes], labels: list[str], steps: int = 400, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Fit a network with Adam on windows drawn at random places and of random lengths."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    target = np.array([languages.index(x) for x in labels])
    mask = _mask().astype(np.float32)
    net = Network(
        languages, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        rng.normal(0, 0.2, mask.shape).astype(np.float32) * mask, np.zeros(mask.shape[1], np.float32),
        rng.normal(0, 0.2, (mask.shape[1], len(languages))).astype(np.float32), np.zeros(len(languages), np.float32),
    )
    weights = [net.embed, net.filters, net.bias, net.dense, net.dense_bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    span = max(WIDTHS)
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(texts), batch)
        windows = np.full((batch, WINDOW), 32, np.uint8)
        for i, r in enumerate(rows):
            text = texts[r]
            length = min(len(text), WINDOW if rng.random() < 0.6 else int(rng.integers(16, WINDOW)))
            at = int(rng.integers(0, len(text) - length + 1))
            windows[i, :length] = np.frombuffer(text, np.uint8)[at : at + length]
        answers, columns = net.pooled(windows)
        at = answers.argmax(axis=1)  # batch x filters
        top = np.take_along_axis(answers, at[:, None, :], axis=1)[:, 0] + net.bias
        hidden = np.maximum(top, 0)
        error = _softmax(hidden @ net.dense + net.dense_bias)
        error[np.arange(batch), target[rows]] -= 1
        error /= batch
        back = (error @ net.dense.T) * (top > 0)
        chosen = columns[np.arange(batch)[:, None], at]  # batch x filters x span*EMBED
        grad_filters = np.einsum("bf,bfk->kf", back, chosen) * mask
        grad_columns = (back[:, :, None] * net.filters.T[None]).reshape(batch, -1, span, EMBED)
        places = at[:, :, None] + np.arange(span)
        grad_embed = np.zeros_like(net.embed)
        np.add.at(grad_embed, windows[np.arange(batch)[:, None, None], places], grad_columns)
        grads = [grad_embed, grad_filters, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
        for w, g, m, v in zip(weights, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= (rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def training_rows(df: DataFrame, text_col="text", label_col="lang", key: Column | None = None, rows_per_language=ROWS_PER_LANGUAGE) -> DataFrame:
    """A bounded sample of (text, label), drawn by hash; of a long text a window of it."""
    text = F.col(text_col)
    key = F.xxhash64(text) if key is None else key
    place = 1 + F.pmod(F.xxhash64(key, F.lit(1)), F.greatest(F.lit(1), F.length(text) - 4 * WINDOW))
    window = F.substr(text, place.cast("int"), F.lit(4 * WINDOW))
    rows = df.where(F.col(label_col).isNotNull()).select(F.col(label_col).alias("label"), key.alias("key"), window.alias("text"))
    return draw(rows, "label", "key", rows_per_language).where(F.col("text").rlike(r"\p{L}")).select("text", "label")


def fit(df: DataFrame, text_col="text", label_col="lang", key: Column | None = None) -> Network | None:
    rows = training_rows(df, text_col, label_col, key).collect()  # bounded: rows_per_language windows of each
    rows = sorted(rows, key=lambda r: (r["label"], r["text"]))
    return train([r["text"].encode() for r in rows], [r["label"] for r in rows]) if rows else None


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of ``texts``, the text that each is of, and the bytes of the text in it."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-sizes // WINDOW))
    buffer = np.full((int(counts.sum()), WINDOW), 32, np.uint8)
    flat, at = buffer.reshape(-1), 0
    for text, n in zip(texts, counts.tolist()):
        flat[at : at + len(text)] = np.frombuffer(text, np.uint8)
        at += n * WINDOW
    owner = np.repeat(np.arange(len(texts)), counts)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return buffer, owner, np.clip(sizes[owner] - start * WINDOW, 1, WINDOW)


def predict(net: Network, texts: list[bytes]) -> np.ndarray:
    """Probability of each language for each text, the mean over its windows."""
    windows, owner, weight = _windows(texts)
    total = np.zeros((len(texts), len(net.languages)))
    for at in range(0, len(windows), 256):
        part = slice(at, at + 256)
        np.add.at(total, owner[part], _softmax(net.logits(windows[part]).astype(np.float64)) * weight[part, None])
    return total / total.sum(axis=1, keepdims=True)


def _predict(batches: Iterator[pa.RecordBatch], net: Network | None, text_col: str, stay: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in byte_slices([batch], text_col, 1 << 20):
            texts = raw_texts(part.column(text_col))
            languages, scores = ["und"] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if net and _LETTER.search(t.decode())]
            if known:
                found = predict(net, [texts[i] for i in known])
                for i, row in zip(known, found):
                    languages[i], scores[i] = net.languages[int(row.argmax())], min(1.0, float(row.max()))
            columns = [part.column(c) for c in stay] + [pa.array(languages), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, names=[*stay, "lang_pred", "lang_score"])


def identify(df: DataFrame, net: Network | None, text_col="text", keep_text=True) -> DataFrame:
    """Add ``lang_pred`` and ``lang_score`` of the whole texts."""
    rows, stay, out = with_added(df, text_col, keep_text, "lang_pred string, lang_score double")
    return rows.mapInArrow(lambda batches: _predict(batches, net, text_col, stay), out)
