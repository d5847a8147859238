"""Reading order and tables from word boxes of documents: lines, blocks, options, key tables.

Input is (doc_id, page, text, x0, x1, top, bottom). What compares neighbours is a window over a page
or document; grouping into lines compares with the first word of the line, which no window can, so
that one step is an Arrow function over the heights of a page's words.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.text import CODE_FONTS, font_family, plain_forms
from ..storage import stored

def _line_numbers(tolerance: float):
    """Number of the line of each top of a page, in order; a line's first word sets its height."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def number(pages: pd.Series) -> pd.Series:
        out = []
        for tops in pages:
            line, first, numbers = -1, None, []
            for top in tops.tolist():
                if first is None or top - first > tolerance:
                    line, first = line + 1, top
                numbers.append(line)
            out.append(numbers)
        return pd.Series(out)

    return number


def _pages(words: DataFrame, tolerance: float) -> DataFrame:
    """(doc_id, page, _w, _n): a page's words by (top, x0), and the number of each one's line."""
    boxes = F.array_sort(F.collect_list(F.struct("top", "x0", "x1", "bottom", "text")))
    pages = words.groupBy("doc_id", "page").agg(boxes.alias("_w"))
    return pages.withColumn("_n", _line_numbers(tolerance)(F.transform("_w", lambda w: w["top"])))


def line_words(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Words with the number of their line: a page's words by (top, x0), where a line ends at a top that is further than that from its first word's."""
    pages = _pages(words, tolerance)
    return pages.select("doc_id", "page", F.inline(F.arrays_zip("_w", "_n"))).select("doc_id", "page", F.col("_n").alias("line"), "_w.*")


def group_lines(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Lines of a page, with the text of their words from left to right.

    Lines are cut out of their page's words, which stand in order, so that no word is shuffled again to meet its line.
    """
    ends = F.filter(F.transform("_n", lambda n, i: F.when(~n.eqNullSafe(F.get("_n", i + 1)), i + 1)), lambda e: e.isNotNull())
    pages = _pages(words, tolerance).select("doc_id", "page", "_w", ends.alias("_e"))
    cut = F.transform("_e", lambda e, k: F.slice("_w", F.coalesce(F.get("_e", k - 1), F.lit(0)) + 1, e - F.coalesce(F.get("_e", k - 1), F.lit(0))))
    lines = pages.select("doc_id", "page", F.posexplode(cut).alias("line", "_l"))
    of = lambda c: F.transform("_l", lambda w: w[c])
    text = F.array_join(F.transform(F.sort_array(F.transform("_l", lambda w: F.struct(w["x0"].alias("x0"), w["top"].alias("top"), w["text"].alias("text")))), lambda x: x["text"]), " ")
    return lines.select(
        "doc_id", "page", "line", F.array_min(of("top")).alias("top"), F.array_max(of("bottom")).alias("bottom"), F.array_min(of("x0")).alias("x0"), F.array_max(of("x1")).alias("x1"), text.alias("text")
    )


def strip_running_text(lines: DataFrame, height: float, band: float = 60.0, min_share: float = 0.6) -> DataFrame:
    """Lines without headers and footers: the same text, but for digits, in the band of most pages."""
    keyed = lines.withColumn("_key", F.when((F.col("top") < band) | (F.col("bottom") > height - band), F.regexp_replace("text", r"\d+", "#")))
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("_pages"))
    seen = keyed.where("_key is not null").groupBy("doc_id", "_key").agg(F.countDistinct("page").alias("_on"))
    running = seen.join(pages, "doc_id").where(F.col("_on") >= F.greatest(F.lit(2), F.round(F.col("_pages") * min_share))).select("doc_id", "_key")
    return keyed.join(running, ["doc_id", "_key"], "left_anti").drop("_key").select(lines.columns)


def strip_running_graphics(graphics: DataFrame, pages: DataFrame, min_share: float = 0.6) -> DataFrame:
    """Graphics without those that stand at the same rounded place on most pages of a document."""
    box = [F.round(c).cast("int").alias(f"_{c}") for c in ("x0", "top", "x1", "bottom")]
    keyed = graphics.select("*", *box)
    keys = ["doc_id", "_x0", "_top", "_x1", "_bottom"]
    total = pages.groupBy("doc_id").agg(F.countDistinct("page").alias("_pages"))
    often = keyed.groupBy(*keys).agg(F.countDistinct("page").alias("_on")).join(total, "doc_id")
    often = often.where(F.col("_on") >= F.greatest(F.lit(2), F.round(F.col("_pages") * min_share))).select(keys)
    return keyed.join(often, keys, "left_anti").select(graphics.columns)


def segment(lines: DataFrame, label: str = r"^\s*(?:Q\.?|Question)\s*(\d+)\b", max_x: float | None = None, lead_tolerance: float = 0.0) -> DataFrame:
    """Add ``label``: the number of the last label line at or above, over the pages of a document.

    Lines right above a label lead into it and get its number: those of its page, one after another upwards, that end
    below its top less ``lead_tolerance``, as a tall first line or a figure beside the label does.
    """
    own = F.regexp_extract("text", label, 1).try_cast("int")
    if max_x is not None:
        own = F.when(F.col("x0") <= max_x, own)
    w = W.partitionBy("doc_id").orderBy("page", "line").rowsBetween(W.unboundedPreceding, 0)
    rows = lines.withColumn("_own", own).withColumn("_above", F.last("_own", True).over(w))
    page = W.partitionBy("doc_id", "page").orderBy("line").rowsBetween(1, W.unboundedFollowing)
    rows = rows.withColumn("_next", F.first(F.when(F.col("_own").isNotNull(), F.struct("line", "top", F.col("_own").alias("number"))), True).over(page))
    clear = F.coalesce(F.col("bottom") <= F.col("_next.top") - lead_tolerance, F.lit(True))
    # from the label upwards, as long as no line is clear of it; the label before is no such line
    upwards = W.partitionBy("doc_id", "page", "_next.line").orderBy(F.desc("line"))
    rows = rows.withColumn("_clear", F.max(clear | F.col("_own").isNotNull()).over(upwards))
    found = F.when(F.col("_own").isNull() & ~F.col("_clear"), F.col("_next.number")).otherwise(F.col("_above"))
    return rows.withColumn("label", found).drop("_own", "_above", "_next", "_clear")


def split_options(words: DataFrame, option: str = r"^\(([A-D])\)(.*)$", column_gap: float = 12.0) -> DataFrame:
    """(doc_id, label, stem, options) of the words of labelled lines: doc_id, label, page, line, x0, x1, text.

    A marker counts at the start of a line or after a gap of at least ``column_gap``, as options stand
    side by side; what is glued to it, and all words up to the next marker, are the option's text. The
    lines of the stem are joined by line breaks.
    """
    by_line = W.partitionBy("doc_id", "page", "line").orderBy("x0", "text")
    before = F.lag("x1").over(by_line)
    opens = F.coalesce(F.col("x0") - before >= column_gap, F.lit(True)) & F.col("text").rlike(option)
    rows = words.where("label is not null").withColumn("_opens", opens)
    own = F.when(F.col("_opens"), F.regexp_extract("text", option, 1))
    so_far = W.partitionBy("doc_id", "label").orderBy("page", "line", "x0", "text").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_key", F.last(own, True).over(so_far))
    rows = rows.withColumn("_t", F.when(F.col("_opens"), F.trim(F.regexp_extract("text", option, 2))).otherwise(F.col("text")))

    def joined(order: list[str], text: str, by: str) -> Column:
        parts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text]), lambda t: t != "")
        return F.array_join(parts, by)

    lines = rows.groupBy("doc_id", "label", "_key", "page", "line").agg(joined(["x0"], "_t", " ").alias("_line"))
    # an option is one text, the stem keeps its lines
    parts = lines.groupBy("doc_id", "label", "_key").agg(joined(["page", "line"], "_line", " ").alias("_text"), joined(["page", "line"], "_line", "\n").alias("_lines"))
    options = F.array_sort(F.collect_list(F.when(F.col("_key").isNotNull(), F.struct(F.col("_key").alias("key"), F.col("_text").alias("text")))))
    return parts.groupBy("doc_id", "label").agg(F.max(F.when(F.col("_key").isNull(), F.col("_lines"))).alias("stem"), options.alias("options"))


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def _header_columns(tokens: DataFrame, names: DataFrame, columns: int) -> DataFrame:
    """(doc_id, page, line, columns): rows of tokens that spell all columns of a profile, each in up to four neighbours."""
    by_row = W.partitionBy("doc_id", "page", "line").orderBy("x0")
    rows = tokens.withColumn("_place", F.row_number().over(by_row))
    following = [F.struct(F.lead("text", k).over(by_row).alias("text"), F.lead("x1", k).over(by_row).alias("x1")) if k else F.struct("text", "x1") for k in range(4)]
    rows = rows.withColumn("_next", F.array(*following))
    runs = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.struct(n.alias("size"), F.slice("_next", F.lit(1), n).alias("run")))
    rows = rows.select("doc_id", "page", "line", "_place", "x0", F.explode(runs).alias("r")).where(F.element_at("r.run", -1)["text"].isNotNull())
    spelled = _plain(F.array_join(F.transform("r.run", lambda t: t["text"]), ""))
    hits = rows.withColumn("_name", spelled).join(names, "_name")
    centre = (F.col("x0") + F.element_at("r.run", -1)["x1"]) / 2
    first = hits.groupBy("doc_id", "page", "line", "position", "column").agg(F.min_by(centre, F.struct("_place", "r.size")).alias("centre"))
    found = F.array_sort(F.collect_list(F.struct("position", "column", "centre")))
    return first.groupBy("doc_id", "page", "line").agg(found.alias("columns")).where(F.size("columns") == columns)


def key_table(lines: DataFrame, profile: dict[str, tuple[str, ...]], number_column: str = "number", cell_gap: float = 8.0) -> DataFrame:
    """Rows of the answer-key tables in word boxes with lines: doc_id, page, line, number, values, error.

    ``profile`` gives each column the spellings of its header, of which case, spaces and marks do not
    count; a header may be stacked over two lines. A page without one goes on with the columns of the
    last page before it that has one. Words closer than ``cell_gap`` are a cell, which belongs to the
    column whose header's centre is nearest; lines without a whole number in ``number_column`` are no
    rows. A document without a header is one row with an ``error``.
    """
    spark = lines.sparkSession
    names = [(i, c, alias) for i, (c, spellings) in enumerate(profile.items()) for alias in spellings]
    names = spark.createDataFrame(names, "position int, column string, alias string").select("position", "column", _plain(F.col("alias")).alias("_name")).distinct()
    keys = ["doc_id", "page", "line"]
    words = stored(lines.select(*keys, "x0", "x1", "top", "text"), "words")
    # only where each column has a word that stands in its spellings, on a line or the one below it, can there be a header
    fits = [F.when(F.exists(F.array(*[_plain(F.lit(a)) for a in spellings]), lambda n: F.contains(n, _plain(F.col("text")))), 1 << i).otherwise(0) for i, spellings in enumerate(profile.values())]
    fit = words.where(_plain(F.col("text")) != "").select(*keys, reduce(lambda x, y: x.bitwiseOR(y), fits).alias("_fit")).where("_fit > 0")
    fit = fit.select("doc_id", "page", F.explode(F.array("line", F.col("line") - 1)).alias("line"), "_fit").groupBy(*keys).agg(F.bit_or("_fit").alias("_fit"))
    heads = stored(fit.where(F.col("_fit") == (1 << len(profile)) - 1).select(*keys), "heads")
    near = heads.select("doc_id", "page", F.explode(F.array("line", F.col("line") + 1)).alias("line")).distinct()
    told = words.join(near, keys, "left_semi")
    both = told.withColumn("pair", F.col("line")).unionByName(told.withColumn("pair", F.col("line") - 1)).drop("line").withColumnRenamed("pair", "line").join(heads, keys, "left_semi")
    by_pair = W.partitionBy(*keys).orderBy("x0", "top", "text")
    apart = F.coalesce(F.col("x0") >= F.max("x1").over(by_pair.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    stacks = both.withColumn("_apart", apart.cast("int")).withColumn("_stack", F.sum("_apart").over(by_pair.rowsBetween(W.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "x0", "text"))), lambda w: w["text"]), " ")
    stacks = stacks.groupBy(*keys, "_stack").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), text.alias("text"))
    # the words of line n stand in row 2n, those of n stacked on n + 1 in row 2n + 1
    row = lambda df, k: df.select("doc_id", "page", (F.col("line") * 2 + k).alias("line"), "x0", "x1", "text")
    headers = _header_columns(row(told, 0).unionByName(row(stacks, 1)), F.broadcast(names), len(profile))
    last = F.floor((F.col("line") + 1) / 2).cast("int").alias("last")
    headers = headers.groupBy("doc_id", "page").agg(F.min_by(F.struct(last, "columns"), "line").alias("h"))
    headers = stored(headers, "headers")
    pages = words.select("doc_id", "page").distinct().join(headers, ["doc_id", "page"], "left")
    pages = carry_headers(pages.select("doc_id", "page", F.coalesce("h.last", F.lit(-1)).alias("last"), F.col("h.columns").alias("columns")), "columns")
    rows = words.join(pages, ["doc_id", "page"]).where(F.col("columns").isNotNull() & (F.col("line") > F.col("last")))
    by_line = W.partitionBy(*keys).orderBy("x0", "text")
    begins = F.coalesce(F.col("x0") - F.lag("x1").over(by_line) > cell_gap, F.lit(True)).cast("int")
    rows = rows.withColumn("_begins", begins).withColumn("_cell", F.sum("_begins").over(by_line.rowsBetween(W.unboundedPreceding, 0)))
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ")
    cells = rows.groupBy(*keys, "_cell").agg(((F.min("x0") + F.max_by("x1", "x0")) / 2).alias("_mid"), F.first("columns").alias("columns"), in_order.alias("text"))
    near = F.array_min(F.transform("columns", lambda c: F.struct(F.abs(c["centre"] - F.col("_mid")).alias("d"), c["position"].alias("p"), c["column"].alias("column"))))
    cells = cells.withColumn("column", near["column"]).groupBy(*keys, "column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_cell", "text"))), lambda c: c["text"]), " ").alias("text"))
    found = cells.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", "text")))).alias("values"))
    number = F.try_element_at("values", F.lit(number_column))
    found = found.where(number.rlike(r"^\d+$")).select(*keys, number.cast("long").alias("number"), "values", F.lit(None).cast("string").alias("error"))
    none = pages.groupBy("doc_id").agg(F.count("columns").alias("_headers")).where("_headers = 0")
    empty = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("page", "line", "number", "values")]
    return found.unionByName(none.select("doc_id", *empty, F.lit("no header").alias("error")))


def nearest_column(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Each cell of (doc_id, page, x0, x1) with the header of (doc_id, page, column, x0, x1) whose centre is nearest."""
    h = headers.select("doc_id", "page", F.col("column").alias("column"), ((F.col("x0") + F.col("x1")) / 2).alias("_hx"))
    rows = cells.withColumn("_cell", F.monotonically_increasing_id()).join(h, ["doc_id", "page"])
    near = F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("_hx"))
    return rows.groupBy("_cell", *cells.columns).agg(F.min_by("column", F.struct(near, "column")).alias("column")).drop("_cell")


def carry_headers(pages: DataFrame, header: str) -> DataFrame:
    """Pages without a header take that of the last page before that has one."""
    w = W.partitionBy("doc_id").orderBy("page").rowsBetween(W.unboundedPreceding, 0)
    return pages.withColumn(header, F.last(header, True).over(w))


def _cells(boxes: DataFrame, side: float) -> DataFrame:
    """Boxes once for each square of their page that they touch, as ``_cx`` and ``_cy``."""
    span = lambda low, high: F.sequence(F.floor(F.col(low) / side), F.floor(F.greatest(low, high) / side))
    return boxes.withColumn("_cx", F.explode(span("x0", "x1"))).withColumn("_cy", F.explode(span("top", "bottom")))


def overlapping(boxes: DataFrame, regions: DataFrame, side: float = 72.0) -> DataFrame:
    """Boxes with the regions of the same page that they overlap.

    Both are dealt to the squares of a grid that they touch and meet there; a pair counts in the square of the upper left corner of what it
    shares, so once. A page of many boxes and regions is so not all their pairs.
    """
    r = _cells(regions.select("doc_id", "page", "region", "x0", "x1", "top", "bottom"), side)
    r = r.select("doc_id", "page", "region", "_cx", "_cy", *[F.col(c).alias(f"_r{c}") for c in ("x0", "x1", "top", "bottom")])
    meets = (F.col("x0") < F.col("_rx1")) & (F.col("x1") > F.col("_rx0")) & (F.col("top") < F.col("_rbottom")) & (F.col("bottom") > F.col("_rtop"))
    here = (F.floor(F.greatest("x0", "_rx0") / side) == F.col("_cx")) & (F.floor(F.greatest("top", "_rtop") / side) == F.col("_cy"))
    return _cells(boxes, side).join(r, ["doc_id", "page", "_cx", "_cy"]).where(meets & here).select(*boxes.columns, "region")


def runs(df: DataFrame, keys: list[str], order: list[str], flag: Column, least: int) -> DataFrame:
    """Runs of at least ``least`` consecutive rows that meet ``flag``: keys, first place and length."""
    w = W.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_flag", flag).withColumn("_place", F.row_number().over(w))
    rows = rows.withColumn("_run", F.col("_place") - F.sum(F.col("_flag").cast("int")).over(w)).where("_flag")
    return rows.groupBy(*keys, "_run").agg(F.min("_place").alias("first_place"), F.count("*").alias("length")).where(F.col("length") >= least).drop("_run")


def join_by_number(blocks: DataFrame, rows: DataFrame, number: str, tie: list[str]) -> DataFrame:
    """Full outer join on the number of the first block and row of each, with what is repeated or missing."""
    def firsts(df: DataFrame, name: str) -> DataFrame:
        place = F.row_number().over(W.partitionBy(number).orderBy(*tie))
        count = F.count("*").over(W.partitionBy(number))
        return df.withColumn("_p", place).withColumn(f"{name}_count", count).where("_p = 1").select(number, f"{name}_count")

    both = firsts(blocks, "block").join(firsts(rows, "row"), number, "full_outer")
    state = F.when(F.col("row_count").isNull(), "block_only").when(F.col("block_count").isNull(), "row_only").otherwise("joined")
    return both.select(number, state.alias("state"), (F.coalesce("block_count", F.lit(0)) > 1).alias("block_repeated"), (F.coalesce("row_count", F.lit(0)) > 1).alias("row_repeated"))


#: Characters that keys print for a minus sign.
MINUS_SIGNS = "\u2212\u2013\u2012\ufe63"


def answer_value(kind: Column, raw: Column) -> Column:
    """Struct of an answer key's value by question type (MCQ, MSQ, NAT), with ``error`` where it does not fit.

    A choice has its ``keys`` of A to D as they are given, once each; a numerical key has all its
    ``ranges``, written "lo to hi" and joined by OR. "MTA" gives marks to all.
    """
    text = F.trim(F.regexp_replace(F.translate(raw, MINUS_SIGNS, "-" * len(MINUS_SIGNS)), r"\s+", " "))
    keys = F.transform(F.split(text, "[;,]"), lambda k: F.upper(F.trim(k)))
    span = r"^(-?\d+(?:\.\d+)?)\s*to\s*(-?\d+(?:\.\d+)?)$"
    parts = F.split(text, r"(?i)\s+OR\s+")
    ranges = F.transform(parts, lambda p: F.struct(*[F.regexp_extract(F.trim(p), span, i).try_cast("double").alias(n) for i, n in ((1, "lo"), (2, "hi"))]))
    to_all = F.upper(text) == "MTA"
    error = (
        F.when(to_all, F.lit(None).cast("string")).when(~F.coalesce(kind.isin("MCQ", "MSQ", "NAT"), F.lit(False)), "unknown type")
        .when((kind == "NAT") & F.exists(ranges, lambda r: r["lo"].isNull()), "not ranges")
        .when((kind == "NAT") & F.exists(ranges, lambda r: r["lo"] > r["hi"]), "a range is upside down")
        .when((kind != "NAT") & F.exists(keys, lambda k: ~k.isin("A", "B", "C", "D")), "not options")
        .when((kind != "NAT") & (F.size(F.array_distinct(keys)) < F.size(keys)), "an option is repeated")
        .when((kind == "MCQ") & (F.size(keys) > 1), "more than one option")
        .when(text.isNull(), "no key")
    )
    good = error.isNull() & ~F.coalesce(to_all, F.lit(False))
    return F.struct(
        F.when(good & kind.isin("MCQ", "MSQ"), keys).alias("keys"), F.when(good & (kind == "NAT"), ranges).alias("ranges"),
        F.coalesce(to_all, F.lit(False)).alias("marks_to_all"), error.alias("error"),
    )


def code_lines(words: DataFrame, fonts: tuple[str, ...] = CODE_FONTS) -> DataFrame:
    """(doc_id, page, line, text, family, code) of words with a font and ``math``: a line's plain text, most frequent font family, and whether it is code.

    Code is a line set mostly in a monospace font; a line into which a formula was written is none.
    """
    family = font_family(F.col("font"))
    is_code = F.lit(False)
    for f in fonts:
        is_code = is_code | F.contains(family, F.lit(f))
    rows = words.select("doc_id", "page", "line", "x0", plain_forms(F.col("text")).alias("text"), family.alias("family"), is_code.alias("mono"), F.coalesce("math", F.lit(False)).alias("math"))
    counts = rows.groupBy("doc_id", "page", "line", "family").agg(F.count("*").alias("n"))
    most = counts.groupBy("doc_id", "page", "line").agg(F.max_by("family", F.struct("n", "family")).alias("family"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ")
    lines = rows.groupBy("doc_id", "page", "line").agg(text.alias("text"), (~F.bool_or("math") & (2 * F.count_if("mono") > F.count("*"))).alias("code"))
    return lines.join(most, ["doc_id", "page", "line"]).select("doc_id", "page", "line", "text", "family", "code")
