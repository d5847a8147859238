"""Fill-in-the-middle forms of texts, by scattering displaced bytes.

A text is cut at two places into prefix, middle and suffix, which a form lists in another order with
a mark before each: ``psm`` is prefix, suffix, middle and ``spm`` suffix, prefix, middle, ``plain`` the text
as it is. Cuts and form depend on the row's id and a seed alone.

All texts of a batch are one byte array. Units, a word with the white space before it or white space
at the end, begin where white space follows a word: one scan finds the cuts. A byte moves by a
displacement that is the same for all of its segment, so a difference array holds the changes at
segment starts, its cumulative sum is every byte's shift, and one numpy scatter builds all outputs;
marks go where their segments begin. :func:`restore` finds the marks in the outputs alone and
gathers the bytes back by the inverse displacement. Scatter and gather go over pieces of ``_PIECE``
bytes, so a text takes a few times its own size, however long.

Defined cases: a null or empty text has no unit and is plain and empty; white space alone is one unit; a text
that holds a mark is plain, so that the outputs of other texts can be told apart; a null id is
written as nothing; repeated rows give equal results; an empty table stays empty; columns named as those that are added are
replaced, all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, raw_texts, with_added

MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
ORDER = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
_PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _draws(row_id: int | None, seed: int) -> tuple[int, int, int, int]:
    digest = sha256(f"{seed}:{'' if row_id is None else row_id}".encode()).hexdigest()
    return tuple(int(digest[8 * k : 8 * k + 8], 16) for k in range(4))


def _unit_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where units begin in the batch's bytes; ``begins`` are those of its texts that are not empty."""
    found = []
    for a in range(0, len(data), _PIECE):
        space = _SPACE[data[max(a - 1, 0) : a + _PIECE]]
        found.append(np.flatnonzero(space[1:] & ~space[:-1]) + max(a - 1, 0) + 1)
    inner = np.concatenate(found) if found else np.zeros(0, np.int64)
    return np.union1d(inner, begins)


def _moved(data: np.ndarray, segments: np.ndarray, shifts: np.ndarray, out: np.ndarray, back: bool = False) -> None:
    """Copy byte i of ``data`` to i plus the shift of its segment, or the other way ``back``.

    ``segments`` are where segments begin, ascending, the first at zero.
    """
    change = np.diff(np.concatenate(([0], shifts)))
    at = carried = 0
    for a in range(0, len(out) if back else len(data), _PIECE):
        b = min(a + _PIECE, len(out) if back else len(data))
        upto = int(np.searchsorted(segments, b))
        step = np.zeros(b - a, np.int64)
        np.add.at(step, segments[at:upto] - a, change[at:upto])
        step[0] += carried
        place = np.cumsum(step)
        carried, at = int(place[-1]), upto
        place += np.arange(a, b)
        if back:
            out[a:b] = data[place]
        else:
            out[place] = data[a:b]


def _segments(starts: list[int], shifts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Segments in order without the empty ones: of those that begin together the last holds the bytes."""
    where, by = np.array(starts, np.int64), np.array(shifts, np.int64)
    last = np.append(where[1:] != where[:-1], True) if len(where) else where.astype(bool)
    return where[last], by[last]


def arrange(texts: list[bytes], ids: list[int | None], plain_below: int, spm_below: int, seed: int) -> tuple[list[bytes], list[int], list[str], list[int | None], list[int | None]]:
    """The form of each text, its bytes in that form, its number of units and the code points of prefix and middle."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    begins = ends - [len(t) for t in texts]
    units = _unit_starts(data, begins[ends > begins])
    first, last = np.searchsorted(units, begins), np.searchsorted(units, ends)
    forms, counts, prefixes, middles, out_starts = [], [], [], [], []
    starts, shifts, marks, at = [], [], [], 0
    for k, text in enumerate(texts):
        n = int(last[k] - first[k])
        h = _draws(ids[k], seed)
        odd = not text or any(m in text for m in MARKS.values())
        form = "plain" if odd or h[2] % 100 >= plain_below else "spm" if h[3] % 100 < spm_below else "psm"
        a, b = int(begins[k]), int(ends[k])
        out_starts.append(at)
        forms.append(form)
        counts.append(n)
        if form == "plain":
            starts.append(a)
            shifts.append(at - a)
            at += b - a
            prefixes.append(None)
            middles.append(None)
            continue
        one, two = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        cuts = [int(units[first[k] + c]) if c < n else b for c in (one, two)]
        spans = {"prefix": (a, cuts[0]), "middle": (cuts[0], cuts[1]), "suffix": (cuts[1], b)}
        placed = {}
        for name in ORDER[form]:
            marks.append((at, MARKS[name]))
            placed[name] = at + 3
            at += 3 + spans[name][1] - spans[name][0]
        for name in ("prefix", "middle", "suffix"):
            starts.append(spans[name][0])
            shifts.append(placed[name] - spans[name][0])
        prefixes.append(len(text[: cuts[0] - a].decode()))
        middles.append(len(text[cuts[0] - a : cuts[1] - a].decode()))
    out = np.empty(at, np.uint8)
    _moved(data, *_segments(starts, shifts), out)
    if marks:
        where = np.array([m for m, _ in marks])
        out[where[:, None] + np.arange(3)] = np.frombuffer(b"".join(m for _, m in marks), np.uint8).reshape(-1, 3)
    bounds = [*out_starts, at]
    whole = out.tobytes()
    return [whole[a:b] for a, b in zip(bounds, bounds[1:])], counts, forms, prefixes, middles


def rebuilt(outputs: list[bytes], forms: list[str]) -> list[bytes]:
    """The texts, from outputs and forms alone."""
    data = np.frombuffer(b"".join(outputs), np.uint8)
    starts, shifts, lengths, at, base = [], [], [], 0, 0
    for out, form in zip(outputs, forms):
        if form == "plain":
            parts = [(0, len(out))]
        else:
            # marks stand in their order, and a text that is not plain holds none
            places = [0]
            for name in ORDER[form][1:]:
                places.append(out.index(MARKS[name], places[-1] + 3))
            spans = {name: (a + 3, b) for name, a, b in zip(ORDER[form], places, [*places[1:], len(out)])}
            parts = [spans[name] for name in ("prefix", "middle", "suffix")]
        begin = at
        for a, b in parts:
            starts.append(at)
            shifts.append(base + a - at)
            at += b - a
        lengths.append(at - begin)
        base += len(out)
    texts = np.empty(at, np.uint8)
    _moved(data, *_segments(starts, shifts), texts, back=True)
    whole, ends = texts.tobytes(), np.cumsum(lengths).tolist()
    return [whole[b - n : b] for b, n in zip(ends, lengths)]


def _arrange(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str, stay: list[str], names: list[str], plain_below: int, spm_below: int, seed: int):
    for batch in batches:
        for part in byte_slices([batch], text_col, 4 << 20):
            outputs, *rest = arrange(raw_texts(part.column(text_col)), part.column(id_col).to_pylist(), plain_below, spm_below, seed)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            columns = [part.column(c) for c in stay] + [pa.array(outputs, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(v, kind) for v, kind in zip(rest, kinds)], names=names)


def infill(df: DataFrame, id_col="doc_id", text_col="text", plain_below=50, spm_below=80, seed=42, keep_text=True) -> DataFrame:
    """Add ``infill_text``, ``n`` units, ``form``, ``prefix_chars`` and ``middle_chars``.

    ``plain_below`` per cent of the texts get another form than plain, ``spm_below`` per cent of those ``spm``.
    """
    added = "infill_text string, n long, form string, prefix_chars long, middle_chars long"
    names = [x.split()[0] for x in added.split(", ")]
    taken = {id_col: "_infill_id"} if id_col in names else {}
    rows, stay, out = with_added(df.withColumnsRenamed(taken), text_col, keep_text, added)
    return rows.mapInArrow(lambda batches: _arrange(batches, taken.get(id_col, id_col), text_col, stay, [*stay, *names], plain_below, spm_below, seed), out)


def _restore(batches: Iterator[pa.RecordBatch], out_col: str, form_col: str, stay: list[str], name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in byte_slices([batch], out_col, 4 << 20):
            texts = rebuilt(raw_texts(part.column(out_col)), part.column(form_col).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(c) for c in stay] + [pa.array(texts, pa.binary()).cast(pa.string())], names=[*stay, name])


def restore(df: DataFrame, out_col="infill_text", form_col="form", text_name="restored_text", keep_out=True) -> DataFrame:
    """Add the exact text, rebuilt from the output and its form."""
    rows, stay, out = with_added(df, out_col, keep_out, f"{text_name} string")
    return rows.mapInArrow(lambda batches: _restore(batches, out_col, form_col, stay, text_name), out)
