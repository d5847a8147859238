"""Repair of conversation structure by weighted interval parsing.

A conversation is a word over its rows' role initials, and the repaired one must be in the language
of ``(s?(ua)+)?``. The language is regular, so its grammar in Chomsky normal form has a nonterminal N[p,q]
for each pair of states of its automaton and the binary rules N[p,q] -> N[p,r] N[r,q]; the lexical rules
are the edits of one row, Keep, Rerole and Delete, and insertions are closed over before and after each. A
chart cell is a span of rows with, for each N[p,q], the least (cost, audit) of edits that lead from p to q.

Cells are combined bottom-up by span length: rows, pairs of rows, spans of four, and so on, where a span
splits in its middle only. That is exact: every derivation in such a grammar splits at each place
between rows, so other splits derive the same. Nor do ties lose anything: an audit tells its own cost, so
of two audits of one cost neither begins the other, and the lesser stays lesser whatever stands before or after.
So a conversation takes time in proportion to its rows, and spans can be combined by different tasks.

In Spark: rows are put in order by a range partitioning of narrow rows (ids, roles and digests, no texts), which also
splits a conversation that holds a third of them, and get a place in a stored table. First copies are found by an
aggregation with map-side combining. Blocks of ``BLOCK`` rows are parsed by the task that has them; the blocks of
a conversation, a few hundred kB of cells for a million rows, are then joined from left to right. Last, texts are
shuffled once, in order behind their conversation's audit, and stream through the hash of the repaired text. Only that last
step and the audit itself see one conversation in one task, as a hash of its text must; the memory it takes is the audit.

Defined cases: null roles and texts are one space, in a null turn or id the checksum sees one space; rows are
ordered by turn, null first, then role and a digest of the text, so rows that differ in text alone have a fixed order; equal rows are
duplicates of the first; a null conversation id is a conversation; roles are told by their first character, an empty one by none, so it is illegal;
conversations that lose all rows get zeros; an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, staged

BLOCK = 1024
#: States: 0 nothing read, 1 after the system's turn, 2 after a user's, 3 after an answer; 0 and 3 accept.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPT = (0, 3)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_SPACE = " \t\n\x0b\f\r"

Cell = dict[tuple[int, int], tuple[int, str]]


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans: N[p,q] -> N[p,r] N[r,q]."""
    out: Cell = {}
    for (p, r), (c1, a1) in left.items():
        for (r2, q), (c2, a2) in right.items():
            if r == r2:
                new = (c1 + c2, a1 + a2)
                if (p, q) not in out or new < out[p, q]:
                    out[p, q] = new
    return out


def _insertions() -> Cell:
    """No row at all: insertions alone, the closure of single ones (three lead anywhere that can be reached)."""
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    step = cell | {(p, q): (INSERT, "I") for (p, x), q in STEPS.items() if x in "ua"}
    for _ in range(3):
        cell = combine(cell, step)
    return cell


EMPTY = _insertions()
_SAME: Cell = {(p, p): (0, "") for p in range(4)}


@lru_cache(None)
def row_cell(shape: str) -> Cell:
    """Edits of one row, with insertions before and after. Shapes: an initial (or ``-``), upper case if truncated, ``!`` if it must go."""
    cell: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if shape != "!":
        extra = TRUNCATED if shape.isupper() or shape == "_" else 0
        for (p, x), q in STEPS.items():
            if x in "ua":
                cell[p, q] = (REROLE + extra, "R")
        for (p, x), q in STEPS.items():
            if x == shape.lower():
                cell[p, q] = (KEEP + extra, "K")
    return combine(combine(EMPTY, cell), EMPTY)


@lru_cache(1 << 14)
def _short(shapes: str) -> Cell:
    return _parse(shapes)


def _parse(shapes: str) -> Cell:
    if len(shapes) == 1:
        return row_cell(shapes)
    half = 1 << (len(shapes) - 1).bit_length() - 1
    part = _short if half <= 16 else _parse
    return combine(part(shapes[:half]), part(shapes[half:]))


def parse(shapes: str) -> Cell:
    """The cell of a whole span of rows."""
    return _parse(shapes) if shapes else _SAME


def best(cell: Cell) -> tuple[int, str]:
    return min(cell[0, q] for q in ACCEPT if (0, q) in cell)


def damaged(rows: DataFrame, id_col="conv_id") -> DataFrame:
    """(conv_id, turn, role, text) after damage by the checksum of id and turn."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(named(id_col), F.lit(":"), named("turn")).cast("binary")) % 20
    rows = rows.select(F.col(id_col).alias("conv_id"), "turn", named("role").alias("role"), named("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "fate")
    return rows.withColumn("_copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_copy", "fate")


def _digests() -> list:
    """Two hashes that tell texts apart, 128 bits; the order of rows that differ in text alone."""
    return [F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(7), "text").alias("d2")]


def _placed(rows: DataFrame) -> DataFrame:
    """Narrow rows in a stored table, with their place in the order of conversations and turns."""
    last = F.substring(F.rtrim("text", F.lit(_SPACE)), -1, 1)
    shapes = rows.select(
        "conv_id", "turn", "role", *_digests(), F.substring("role", 1, 1).alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    order = ["conv_id", "turn", "role", "d1", "d2", "_tie"]
    shapes = shapes.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    return staged(shapes.withColumn("place", F.monotonically_increasing_id()), "turns")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, block, first initial, last initial, illegal, pairs, costs, audits) of each block of rows, which stand together."""
    held: tuple | None = None
    shapes: list[str] = []
    initials: list[str] = []

    def row() -> tuple:
        cell = parse("".join(shapes))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        return *held, initials[0], initials[-1], illegal, [4 * p + q for p, q in cell], [c for c, _ in cell.values()], [a for _, a in cell.values()]

    def packed(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())]
        names = "conv_id block first last illegal pairs costs audits".split()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    kind = None
    for batch in batches:
        kind, done = batch.schema.field("conv_id").type, []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "block", "initial", "cut", "gone")]
        for conv, block, initial, cut, gone in zip(*columns):
            if held != (conv, block):
                if held:
                    done.append(row())
                held, shapes, initials = (conv, block), [], []
            shape = initial if initial in ("s", "u", "a") else "-"
            shapes.append("!" if gone else shape.upper().replace("-", "_") if cut else shape)
            initials.append(initial)
        if done:
            yield packed(done, kind)
    if held:
        yield packed([row()], kind)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, illegal, cost, audit) of each conversation, from its blocks in order."""
    held, some = [], False
    reached: Cell = {}
    illegal, before = 0, ""
    rows: list[tuple] = []

    def end() -> None:
        cost, audit = best(reached)
        rows.append((held[0], illegal, cost, audit))

    kind = None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        names = ("conv_id", "first", "last", "illegal", "pairs", "costs", "audits")
        for r in zip(*[batch.column(c).to_pylist() for c in names]):
            conv, first, last, own, pairs, costs, audits = r
            if not some or held[0] != conv:
                if some:
                    end()
                held, some, reached, illegal, before = [conv], True, {(0, 0): (0, "")}, 0, None
            illegal += own + (before is not None and before + first not in ("su", "ua", "au"))
            before = last
            cell = {divmod(k, 4): (c, a) for k, c, a in zip(pairs, costs, audits)}
            reached = combine(reached, cell)
        if rows:
            yield _audits(rows, kind)
            rows = []
    if some:
        end()
        yield _audits(rows, kind)


def _audits(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["conv_id", "illegal", "cost", "audit"])


def _hashes(batches: Iterator[pa.RecordBatch], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Each conversation's report with the hash of its repaired text, from its report and then its rows in order."""
    report: dict | None = None
    digest, state, at, begun = hashlib.sha256(), 0, 0, False
    done: list[dict] = []

    def insert() -> None:
        """Edits that take no row."""
        nonlocal at
        while at < len(report["audit"]) and report["audit"][at] == "I":
            put("assistant" if state == 2 else "user", "")
            at += 1

    def put(role: str, text: str) -> None:
        nonlocal state, begun
        state = STEPS[state, role[0]]
        digest.update((b"\n" if begun else b"") + f"{role}:{text}".encode())
        begun = True

    def end() -> None:
        insert()
        done.append(report | {"repaired_sha256": digest.hexdigest()})

    for batch in byte_slices(batches, "text", 4 << 20):
        columns = [batch.column(c).to_pylist() for c in ("report", "role", "text")]
        for header, role, text in zip(*columns):
            if header is not None:
                if report:
                    end()
                report, digest, state, at, begun = header, hashlib.sha256(), 0, 0, False
                continue
            insert()
            edit = report["audit"][at]
            at += 1
            if edit != "D":
                put(role if edit == "K" else "assistant" if state == 2 else "user", text)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema(kinds.items()))
            done = []
    if report:
        end()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema(kinds.items()))


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """A report for each conversation of ``rows`` (conv_id, turn, role, text), and of ``conversations`` (conv_id) without rows.

    gaps in the turns, rows that are blank, duplicate or truncated, illegal neighbours, the cost and audit of the
    cheapest repair, and the hash of the repaired conversation.
    """
    shapes = _placed(rows)
    first = shapes.groupBy(F.col("conv_id").alias("of"), F.col("role").alias("r"), F.col("d1").alias("e1"), F.col("d2").alias("e2")).agg(F.min("place").alias("first_place"))
    found = shapes.join(first, F.expr("conv_id <=> of and role = r and d1 = e1 and d2 = e2")).select(
        "conv_id", "turn", "initial", "place", "blank", (~F.col("blank") & (F.col("place") > F.col("first_place"))).alias("duplicate"), "cut"
    )
    found = staged(found.withColumn("cut", F.col("cut") & ~F.col("blank") & ~F.col("duplicate")), "faults")
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    span = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    counts = found.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).alias("gaps"), count("blank"), count("duplicate"), count("cut"))
    block = F.shiftright("place", BLOCK.bit_length() - 1)  # the rows of a partition are numbered on end
    narrow = found.select("conv_id", block.alias("block"), "place", "initial", "cut", (F.col("blank") | F.col("duplicate")).alias("gone"))
    kind = found.schema["conv_id"].dataType.simpleString()
    cells = narrow.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place").mapInArrow(
        _blocks, f"conv_id {kind}, block long, first string, last string, illegal long, pairs array<int>, costs array<long>, audits array<string>"
    )
    audits = cells.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_joined, f"conv_id {kind}, illegal long, cost long, audit string")
    none = (rows if conversations is None else conversations).select("conv_id").distinct()
    zeros = none.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "cut", "illegal", "cost")], F.lit("").alias("audit"))
    total = lambda c: F.sum(c).alias(c)
    parts = zeros.unionByName(counts, allowMissingColumns=True).unionByName(audits, allowMissingColumns=True)
    numbers = ["gaps", "blank", "duplicate", "cut", "illegal", "cost"]
    reports = parts.groupBy("conv_id").agg(*[total(c) for c in numbers], F.max("audit").alias("audit"))
    reports = reports.select(F.struct("conv_id", "gaps", "blank", "duplicate", F.col("cut").alias("truncated"), "illegal", "cost", "audit").alias("report"))
    schema = reports.schema["report"].dataType
    stream = reports.select("report", F.col("report.conv_id").alias("conv_id"), *[F.lit(None).cast(k).alias(c) for c, k in (("turn", "long"), ("role", "string"), ("text", "string"), ("d1", "long"), ("d2", "long"))])
    texts = rows.select(F.lit(None).cast(schema).alias("report"), "conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", *_digests())
    order = ["conv_id", F.col("report").isNull(), "turn", "role", "d1", "d2"]
    whole = stream.unionByName(texts).repartition("conv_id").sortWithinPartitions(*order).select("report", "role", "text")
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", repaired_sha256 string"
    kinds = {f.name: _arrow(f.dataType) for f in schema.fields} | {"repaired_sha256": pa.string()}
    return whole.mapInArrow(lambda batches: _hashes(batches, kinds), out)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
