"""Answer shapes of questions and the grading of attempts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import nfc, normalize_text


def _normalized(texts: Column) -> Column:
    """The normalised form of each text, composed in one go: a control character keeps them apart."""
    parts = F.split(nfc(F.array_join(texts, "\x1f", "")), "\x1f")
    plain = F.transform(parts, lambda o: normalize_text(o, compose=False))
    return F.when(F.size(texts) > 0, plain).otherwise(F.array().cast("array<string>"))


def option_set(options: Column) -> Column:
    """Normalised option texts as a sorted set, so that reordered options are equal."""
    return F.array_sort(F.array_distinct(_normalized(options)))


def range_text(lo: Column, hi: Column) -> Column:
    return F.concat(lo.cast("double").cast("string"), F.lit(".."), hi.cast("double").cast("string"))


def correct_set(kind: Column, correct_texts: Column, ranges: Column, text: Column) -> Column:
    """The correct side of an answer shape by answer type: option texts, ranges, or the text or number.

    ``correct_texts`` are those of the correct keys that are options; of an unknown type it is empty.
    """
    none = F.array().cast("array<string>")
    by_range = F.transform(ranges, lambda r: range_text(r["lo"], r["hi"]))
    plain = F.when(text.isNotNull(), F.array(normalize_text(text)))
    found = (
        F.when(kind.isin("mcq", "multiple_correct"), _normalized(correct_texts))
        .when((kind == "numerical") & (F.size(ranges) > 0), by_range)
        .when(kind.isin("numerical", "text"), plain)
    )
    return F.array_sort(F.array_distinct(F.coalesce(found, none)))


def published_shape(questions: DataFrame, options: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, options, answers): the shape of each published question, as :func:`option_set` and :func:`correct_set` give it.

    ``options`` has id, question_id, option_text; ``answers`` has question_id, correct_option_id, text_answer,
    numerical_answer, numeric_min and numeric_max. A question has a bounded number of either.
    """
    norm = options.select("id", "question_id", normalize_text(F.col("option_text")).alias("norm"))
    right = answers.where("correct_option_id is not null").select(F.col("correct_option_id").alias("id")).distinct().withColumn("_right", F.lit(True))
    chosen = norm.join(right, "id", "left").groupBy("question_id").agg(
        F.collect_set("norm").alias("options"), F.collect_set(F.when(F.col("_right"), F.col("norm"))).alias("by_option"))
    value = F.coalesce("text_answer", F.col("numerical_answer").cast("string"))
    bounds = F.when(F.col("numeric_min").isNotNull() & F.col("numeric_max").isNotNull(), range_text(F.col("numeric_min"), F.col("numeric_max")))
    typed = answers.where("correct_option_id is null").groupBy("question_id").agg(F.collect_set(F.coalesce(bounds, normalize_text(value))).alias("by_value"))
    none = F.array().cast("array<string>")
    rows = questions.select("id").join(chosen.withColumnRenamed("question_id", "id"), "id", "left").join(typed.withColumnRenamed("question_id", "id"), "id", "left")
    both = F.array_union(F.coalesce("by_option", none), F.coalesce("by_value", none))
    return rows.select("id", F.array_sort(F.coalesce("options", none)).alias("options"), F.array_sort(both).alias("answers"))


def parse_number(raw: Column) -> Column:
    """A decimal number; a comma is a decimal point where there is no point. Else null."""
    text = F.trim(raw)
    text = F.when(~F.contains(text, F.lit(".")), F.replace(text, F.lit(","), F.lit("."))).otherwise(text)
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), text.try_cast("double"))


def grade_numeric(raw: Column, ranges: Column, text: Column) -> Column:
    """In any inclusive range; without ranges, equal as text or as a number."""
    value = parse_number(raw)
    in_range = F.exists(ranges, lambda r: value.between(r["lo"], r["hi"]))
    alike = (F.trim(raw) == F.trim(text)) | (value == parse_number(text))
    return F.coalesce(F.when(F.size(ranges) > 0, in_range).otherwise(alike), F.lit(False))


def grade_selection(selected: Column, correct: Column) -> Column:
    """The selected set is not empty and equals the correct one."""
    chosen = F.array_sort(F.array_distinct(selected))
    return F.coalesce((F.size(chosen) > 0) & (chosen == F.array_sort(F.array_distinct(correct))), F.lit(False))


def range_label(lo: Column, hi: Column) -> Column:
    return F.when(lo == hi, lo.cast("string")).otherwise(F.concat(lo.cast("string"), F.lit(" to "), hi.cast("string")))
