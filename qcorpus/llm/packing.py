"""Packing of tokenised documents into sequences by the sum-of-squares rule.

A piece goes where the sum over residual gaps of the squared number of open sequences with that
gap becomes smallest (Csirik et al., 1999), a new sequence being one of the choices. Documents
are tokenised in their partitions; only (document, piece, length, checksum) are shuffled. Pieces
are dealt to bins of about ``bin_pieces`` by a hash of document and piece and each bin is packed on
its own, so no task holds more than one bin, whatever one source or text holds. The sequences that
the bins leave open are then dealt to bins and packed by the same rule, as if each were a piece.

Tokens are read word by word: the tokenizer splits at white space, so the ids of a word between
ASCII white space do not depend on its neighbours. Lower-cased words are looked up in a bounded
memory, and only new ones are tokenised, without the marks at their end. A text that spells a
special token is handed to the tokenizer whole.

Defined cases: null and empty texts are a piece of one token, the end token; every row is a
document, so repeated rows are packed each; a null id stays null; other columns are ignored.
"""

from __future__ import annotations

import os
import string
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, staged

_SIZE = 4096
#: Words that a task remembers; then it starts afresh, so memory is bounded.
_REMEMBER = 650_000
#: ASCII marks but the quotes, which the tokenizer may join with what follows.
_MARKS = bytes(set(string.punctuation.encode()) - set(b"'\""))


class WordIds(dict):
    """From a lower-case word to its token ids, as 32-bit integers in the order of a little-endian machine."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.load = lambda: Tokenizer.from_file(path)
        self.whole: Tokenizer | None = None  # loaded for the first text that spells a special token
        self.tokenizer = self.load()
        self.tokenizer.encode_special_tokens = True  # words, of which lower-casing may make a special token
        self.special = [token.content.encode() for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def learn(self, words: set[bytes]) -> None:
        """Remember ``words``. A run of ASCII marks after a letter or digit is a token run of its own."""
        ended = {w for w in words if w[-1] in _MARKS}
        cut, new = [], words - ended
        for word in ended:
            head = word.rstrip(_MARKS)
            if head and (head[-1:].isalnum() or head[-1] >= 0x80 and head.decode()[-1].isalpha()):
                tail = word[len(head) :]
                cut.append((word, head, tail))
                new.add(head)
                new.add(tail)
            else:
                new.add(word)
        new -= self.keys()
        single = [w for w in new if w.isalpha() or w.decode().isalpha()]
        other = list(new.difference(single))
        for at in range(0, len(single), 500):
            some = single[at : at + 500]
            found = self._joined(some)
            if found is None:
                other += some
            else:
                self.update(zip(some, found))
        found = self.tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False)
        self.update(zip(other, [array("I", x.ids).tobytes() for x in found]))
        for word, head, tail in cut:
            self[word] = self[head] + self[tail]

    def _joined(self, words: list[bytes]) -> list[bytes] | None:
        """Token ids of words of letters, read as one text and cut where a token ends a word.

        None if the number of ends is not that of the words.
        """
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, np.uint32)
        cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(cuts) != len(words) or cuts[-1] != 4 * len(ids):
            return None
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *cuts], cuts)]

    def documents(self, texts: list[bytes]) -> list[bytes]:
        """Token ids of each of ``texts``."""
        if len(self) > _REMEMBER:
            self.clear()
        special = [any(token in t for token in self.special) for t in texts]
        split = [[] if odd else t.lower().split() for t, odd in zip(texts, special)]
        found = [list(map(self.get, words)) for words in split]
        self.learn({w for words, ids in zip(split, found) for w, x in zip(words, ids) if x is None})
        whole = [b"".join([self[w] if x is None else x for w, x in zip(words, ids)]) for words, ids in zip(split, found)]
        return [self._whole(t) if odd else ids for t, ids, odd in zip(texts, whole, special)]

    def _whole(self, text: bytes) -> bytes:
        self.whole = self.whole or self.load()
        return array("I", self.whole.encode(text.decode(), add_special_tokens=False).ids).tobytes()


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, size: int) -> Iterator[pa.RecordBatch]:
    ids = WordIds(path)
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        for part in byte_slices([batch], "text", 1 << 20):
            rows = []
            texts = [x.as_py() or b"" for x in part.column("text")]
            for doc, tokens in zip(part.column("doc_id").to_pylist(), ids.documents(texts)):
                tokens += end
                for i, at in enumerate(range(0, len(tokens), 4 * size)):
                    piece = tokens[at : at + 4 * size]
                    rows.append((doc, i, at // 4, len(piece) // 4, zlib.crc32(piece)))
            kinds = [part.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )


def token_pieces(df: DataFrame, tokenizer_path: str, id_col="doc_id", text_col="text", end_id=1, size=_SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, cut only where it is too long."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(lambda batches: _pieces(batches, tokenizer_path, end_id, size), out)


def sum_of_squares(lengths: np.ndarray, size: int = _SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, placed in the given order."""
    gaps = np.zeros(size + 1, np.int64)  # open sequences by what they have left
    gaps_open: list[list[int]] = [[] for _ in range(size + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for i, length in enumerate(lengths.tolist()):
        # change of the sum of squares: -2n+1 where it goes from, +2m+1 where it comes to
        best, rest = -1, size - length
        cost = 2 * int(gaps[rest]) + 1 if rest else 0
        if length < size:
            own = gaps[length:size]
            change = 2 * (gaps[: size - length] - own) + 2
            change[0] = 1 - 2 * own[0]  # closed: nothing comes to gap zero
            change[own == 0] = 1 << 40
            at = int(change.argmin())
            if change[at] <= cost:
                best = at + length
        if best < 0:
            best, made = size, made + 1
            number = made - 1
        else:
            number = gaps_open[best].pop()
            gaps[best] -= 1
        sequence[i], offset[i] = number, size - best
        rest = best - length
        if rest:
            gaps[rest] += 1
            gaps_open[rest].append(number)
    return sequence, offset


def placing_order(lengths: np.ndarray, checksums: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """The longer pieces in the random order of their checksums, then the shortest, long ones first.

    The rule works best on random orders; the short pieces fill what is left open at the end.
    """
    short = lengths <= np.quantile(lengths, 0.3)
    mixed = (checksums.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    return np.lexsort((tie, mixed, np.where(short, -lengths, 0), short))


def _packer(size: int, order_by: list[str]) -> Callable[[tuple, pa.Table], pa.Table]:
    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in order_by])
        lengths, sums = rows["length"].to_numpy(), rows["ids_crc32"].to_numpy()
        order = placing_order(lengths, sums, np.arange(len(lengths)))
        sequence, offset = sum_of_squares(lengths[order], size)
        rows = rows.take(pa.array(order)).drop_columns(["bin"])
        numbers = pa.array(sequence + (key[0].as_py() << 40))
        return rows.append_column("sequence_id", numbers).append_column("offset", pa.array(offset))

    return pack


def _pack_bins(pieces: DataFrame, key: list[str], size: int, bin_pieces: int) -> DataFrame:
    bins = -(-pieces.count() // bin_pieces) or 1
    dealt = pieces.withColumn("bin", F.pmod(F.xxhash64(*key, F.lit(7)), F.lit(bins)))
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return dealt.groupBy("bin").applyInArrow(_packer(size, key), f"{out}, sequence_id long, offset long")


def pack(pieces: DataFrame, size: int = _SIZE, bin_pieces: int = 1 << 14) -> DataFrame:
    """Add ``sequence_id`` and ``offset``. ``pieces`` is read twice, so hand in a stored table."""
    placed = staged(_pack_bins(pieces, ["doc_id", "piece", "start", "ids_crc32"], size, bin_pieces), "placed")
    rests = placed.groupBy("sequence_id").agg(F.sum("length").alias("length")).where(F.col("length") < size)
    rests = rests.select(F.col("sequence_id").alias("rest"), "length", F.pmod(F.xxhash64("sequence_id"), F.lit(1 << 32)).alias("ids_crc32"))
    rests = _pack_bins(staged(rests, "rests"), ["rest"], size, bin_pieces)
    # sequences made of rests are numbered below zero
    rests = rests.select("rest", (-1 - F.col("sequence_id")).alias("_sequence"), F.col("offset").alias("_offset"))
    found = placed.join(rests, F.col("sequence_id") == F.col("rest"), "left")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return found.select(
        *names, F.coalesce("_sequence", "sequence_id").alias("sequence_id"),
        (F.col("offset") + F.coalesce("_offset", F.lit(0))).alias("offset"),
    )
