"""Review batches: splitting, quality checks, documents for the reviewer, listings and audit rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .layout import overlapping, runs


def split_batch(batches: DataFrame, elements: str = "elements") -> DataFrame:
    """One row per element of a batch: its declared number, else its place, and whether it can be published."""
    rows = batches.select("batch", F.posexplode(elements).alias("place", "e"))
    number = F.coalesce(F.col("e.number"), F.col("place") + 1)
    ready = F.col("e.normalized").isNotNull()
    return rows.select("batch", "place", number.cast("int").alias("number"), ready.alias("publishable"), F.col("e.normalized").alias("normalized"))


def batch_document(items: DataFrame, batch: str, order: list[str], fields: list[str], metadata: list[str]) -> DataFrame:
    """A batch as one JSON document {metadata, extractedElements}, its elements in order."""
    parts = F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order])))
    elements = F.transform(parts, lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    facts = F.struct(*[F.min(m).alias(m) for m in metadata], F.count("*").alias("count"))
    return items.groupBy(batch).agg(F.to_json(F.struct(facts.alias("metadata"), elements.alias("extractedElements"))).alias("document"))


def content_report(files: DataFrame, file: str, errors: Column, warnings: Column) -> DataFrame:
    """Totals of a content folder; the valid questions are all less the errors, not below none."""
    per = files.groupBy(file).agg(F.count("*").alias("questions"), F.sum(errors).alias("errors"), F.sum(warnings).alias("warnings"))
    return per.agg(
        F.count("*").alias("files"), F.sum("questions").alias("questions"),
        F.sum(F.greatest(F.col("questions") - F.col("errors"), F.lit(0))).alias("valid_questions"), F.count_if(F.col("errors") > 0).alias("needs_review"),
    )


def position_decision(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """What a new parse says of a position that is taken: same, same_new (other options) or different.

    Both have the keys, norm, options and answers.
    """
    old = existing.select(*keys, F.col("norm").alias("_n"), F.col("options").alias("_o"), F.col("answers").alias("_a"))
    same_text = F.col("norm").eqNullSafe(F.col("_n"))
    decision = (
        F.when(F.col("_n").isNull(), "free").when(~same_text, "different")
        .when(F.col("options").eqNullSafe(F.col("_o")) & F.col("answers").eqNullSafe(F.col("_a")), "same").otherwise("same_new")
    )
    return incoming.join(old, keys, "left").select(*incoming.columns, decision.alias("decision"))


def media_positions(media: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Running position, from 0, of images within a question's place."""
    return media.withColumn("position", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)


def audit_rows(before: DataFrame, after: DataFrame, key: str, actor: Column, action: str) -> DataFrame:
    """One audit row for each entity whose row changed, with the old and new values as JSON."""
    values = [c for c in before.columns if c != key]
    a = before.select(key, F.struct(*values).alias("_old"))
    b = after.select(key, F.struct(*values).alias("_new"))
    both = a.join(b, key, "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new")))
    return both.select(F.col(key).alias("entity_id"), actor.alias("actor_id"), F.lit(action).alias("action"), F.to_json("_old").alias("old_value"), F.to_json("_new").alias("new_value"))


def newest(df: DataFrame, at: str, tie: str, limit: int, **equals: object) -> DataFrame:
    """A listing: optional equality filters, newest first, limited."""
    for name, value in equals.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df.orderBy(F.desc(at), tie).limit(limit)


def detect_issues(lines: DataFrame, gap: float = 18.0, lone_run: int = 3) -> DataFrame:
    """(doc_id, label, code, n) of layout trouble in labelled lines: lone tokens, gaps and unbalanced math.

    Lone tokens are runs of lines of one short token, as a formula set in pieces leaves; a gap is a
    vertical distance no paragraph has; math is unbalanced if brackets of a label's lines do not match.
    """
    w = W.partitionBy("doc_id", "page", "label").orderBy("line")
    rows = lines.where("label is not null").withColumn("_lone", F.trim("text").rlike(r"^\S{1,3}$"))
    rows = rows.withColumn("_gap", F.col("top") - F.lag("bottom").over(w) > gap)
    rows = rows.withColumn("_place", F.row_number().over(w)).withColumn("_run", F.col("_place") - F.sum(F.col("_lone").cast("int")).over(w))
    lone = rows.where("_lone").groupBy("doc_id", "page", "label", "_run").agg(F.count("*").alias("n")).where(F.col("n") >= lone_run)
    lone = lone.groupBy("doc_id", "label").agg(F.sum("n").alias("n")).withColumn("code", F.lit("math_fragments"))
    gaps = rows.where("_gap").groupBy("doc_id", "label").agg(F.count("*").alias("n")).withColumn("code", F.lit("layout_gap"))
    count = lambda c: F.sum(F.length("text") - F.length(F.replace("text", F.lit(c), F.lit(""))))
    sides = rows.groupBy("doc_id", "label").agg(F.abs(count("(") - count(")")).alias("n")).where("n > 0").withColumn("code", F.lit("math_brackets"))
    names = ["doc_id", "label", "code", "n"]
    return lone.select(names).unionByName(gaps.select(names)).unionByName(sides.select(names))


#: The codes and details of layout trouble.
LAYOUT_ISSUES = {
    "drawn": ("figure", "something is drawn in the question"),
    "tall": ("figure", "a tall block with almost no words"),
    "image_option": ("image_option", "an option has no text"),
    "glyphs": ("math", "math or private-use glyphs"),
    "script_row": ("math", "a row of sub- or superscripts"),
    "script_word": ("math", "an inline sub- or superscript"),
    "stacked": ("math", "single tokens stacked on 3+ lines"),
    "wide": ("layout", "wide gaps inside a line"),
}


@dataclass(frozen=True)
class QualityProfile:
    """Distances, in points, and sizes by which a publisher's layout is judged."""

    script_line_gap: float = 9.0
    script_size: float = 0.8
    wide_gap: float = 40.0
    tall_empty_block: float = 120.0
    few_words: int = 5
    stacked: int = 3
    option: str = r"^\([A-D]\)"


def question_issues(words: DataFrame, options: DataFrame, regions: DataFrame, graphics: DataFrame, profile: QualityProfile = QualityProfile()) -> DataFrame:
    """(doc_id, label, code, detail) of layout trouble in questions, each once.

    Words have doc_id, label, page, line, x0, x1, top, size, text and ``stem``, whether their line stands before the options; options
    doc_id, label, text; regions doc_id, label, region, page, x0, top, x1, bottom; graphics doc_id, page, kind and a box.
    Codes: figure (something drawn in a region; a tall first region with few words), image_option (an option without text), math
    (glyphs of mathematics or private use; a row right below another; a small word in a line; short tokens stacked) and layout
    (wide gaps inside a line of the stem). Marks of options count neither as script nor as tokens.
    """
    key = ["doc_id", "label"]
    line = [*key, "page", "line"]
    marked = lambda c: F.col(c).rlike(profile.option)

    def told(found: DataFrame, name: str) -> DataFrame:
        code, detail = LAYOUT_ISSUES[name]
        return found.select(*key, F.lit(code).alias("code"), F.lit(detail).alias("detail")).distinct()

    # a hairline box is the border of a table
    drawn = graphics.where((F.col("kind") != "rect") | ((F.col("x1") - F.col("x0") > 2) & (F.col("bottom") - F.col("top") > 2))).select("doc_id", "page", "x0", "x1", "top", "bottom")
    places = regions.select("doc_id", "page", F.struct("label", "region").alias("region"), "x0", "x1", "top", "bottom")
    met = overlapping(drawn, places).select("doc_id", F.col("region.label").alias("label"))
    counts = words.groupBy(*key).agg(F.count("*").alias("n"))
    first = regions.groupBy(*key).agg(F.min_by(F.col("bottom") - F.col("top"), "region").alias("height"))
    tall = first.where(F.col("height") > profile.tall_empty_block).join(counts, key, "left").where(F.coalesce("n", F.lit(0)) < profile.few_words)
    glyphs = words.where(F.col("text").rlike(r"[\x{1D400}-\x{1D7FF}\x{E000}-\x{F8FF}]"))
    in_line = words.groupBy(*line).agg(
        F.min("top").alias("top"), F.count("*").alias("n"), F.min_by("text", "x0").alias("first"), F.median(F.when(F.col("size") > 0, F.col("size"))).alias("median"))
    order = W.partitionBy(*key).orderBy("page", "line")
    rows = in_line.where(~marked("first")).withColumns({"_page": F.lag("page").over(order), "_step": F.col("top") - F.lag("top").over(order)})
    rows = rows.where((F.col("_page") == F.col("page")) & (F.col("_step") > 0) & (F.col("_step") < profile.script_line_gap))
    small = words.join(in_line.select(*line, "median"), line).where((F.col("size") > 0) & (F.col("size") < profile.script_size * F.col("median")) & ~marked("text"))
    lone = (F.col("n") == 1) & (F.length("first") <= 3) & ~marked("first")
    stacks = runs(in_line, key, ["page", "line"], lone, profile.stacked)
    gap = F.col("x0") - F.lag("x1").over(W.partitionBy(*line).orderBy("x0", "text"))
    wide = words.where("stem").withColumn("_gap", gap).where(F.col("_gap") >= profile.wide_gap)
    bare = options.where(F.trim(F.coalesce("text", F.lit(""))) == "")
    parts = [
        told(met, "drawn"), told(tall, "tall"), told(bare, "image_option"), told(glyphs, "glyphs"),
        told(rows, "script_row"), told(small, "script_word"), told(stacks, "stacked"), told(wide, "wide"),
    ]
    return reduce(DataFrame.unionByName, parts)


def count_reports(reports: DataFrame, key: str, counts: list[str]) -> tuple[DataFrame, DataFrame]:
    """Counts by ``key`` as (path, json), fields by name, and as the (place, line) rows of a Markdown table with a total.

    Both are stable: a rerun with nothing changed writes the same.
    """
    files = reports.select(F.concat(key, F.lit(".json")).alias("path"), F.to_json(F.struct(*sorted(counts))).alias("json"))
    cell = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    line = lambda head, cells: F.concat(F.lit("| "), head, F.lit(" | "), F.concat_ws(" | ", *cells), F.lit(" |"))
    link = F.concat(F.lit("["), F.col(key), F.lit("]("), F.col(key), F.lit(".json)"))
    rows = reports.select(F.struct(F.lit(1).alias("part"), F.col(key).alias("key")).alias("place"), line(link, [cell(c) for c in counts]).alias("line"))
    total = reports.agg(*[F.sum(c).alias(c) for c in counts], F.count("*").alias("_n")).where("_n > 0")
    bold = [F.concat(F.lit("**"), cell(c), F.lit("**")) for c in counts]
    last = total.select(F.struct(F.lit(2).alias("part"), F.lit("").alias("key")).alias("place"), line(F.lit("**All**"), bold).alias("line"))
    return files, rows.unionByName(last).orderBy("place")
