"""Practice: attempts graded against all answers of their questions, and the sessions they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.answers import grade_numeric, grade_selection
from .merge import merge_upsert


def answer_keys(answers: DataFrame) -> DataFrame:
    """(question_id, correct, ranges, text_answer) of answers (question_id, option_id, numeric_min, numeric_max, text_answer)."""
    span = F.when(F.col("numeric_min").isNotNull() & F.col("numeric_max").isNotNull(), F.struct(F.col("numeric_min").alias("lo"), F.col("numeric_max").alias("hi")))
    return answers.groupBy("question_id").agg(F.collect_set("option_id").alias("correct"), F.array_sort(F.collect_list(span)).alias("ranges"), F.min("text_answer").alias("text_answer"))


def record_attempts(attempts: DataFrame, answers: DataFrame) -> DataFrame:
    """Attempts (id, question_id, selected, numeric_answer, user_id, session_id) as rows to store, with ``is_correct``.

    A typed answer is graded as a number or text, options as a whole set. Attempts on questions that
    are not there are dropped; an attempt of a user has no anonymous session.
    """
    rows = attempts.join(answer_keys(answers), "question_id")
    chosen = F.array_distinct(F.coalesce("selected", F.array().cast("array<string>")))
    right = F.when(F.col("numeric_answer").isNotNull(), grade_numeric(F.col("numeric_answer"), F.col("ranges"), F.col("text_answer"))).otherwise(grade_selection(chosen, F.col("correct")))
    return rows.select(
        "id", "question_id", "user_id", F.when(F.col("user_id").isNull(), F.col("session_id")).alias("session_id"),
        F.get(chosen, F.lit(0)).alias("first_option"), chosen.alias("selected"), F.col("numeric_answer").alias("text_answer"), right.alias("is_correct"))


def finish_sessions(sessions: DataFrame, results: DataFrame) -> DataFrame:
    """Practice sessions by id with what their results say: correct, incorrect, skipped, seconds, completed_at."""
    known = results.join(sessions.select("id"), "id", "left_semi")
    return merge_upsert(sessions, known, ["id"], update=[c for c in results.columns if c != "id"])
