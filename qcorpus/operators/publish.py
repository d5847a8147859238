"""Validation, stable identities and the set-based publish of normalised questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import content_hash, normalize_text
from .merge import append_numbered, insert_absent, merge_upsert

#: The order of key states, which only move forward.
KEY_STATUS = ("none", "provisional", "final", "revised")


def key_rank(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in KEY_STATUS]), F.coalesce(status, F.lit("none")))


def _component(slug: Column) -> Column:
    return F.translate(slug, " _", "--")


def _period(year: Column, session: Column) -> Column:
    return F.coalesce(year.cast("string"), F.nullif(session, F.lit("")), F.lit("v1"))


def stable_content_id(
    exam: Column, variant: Column, year: Column, session: Column, subject: Column, shift: Column,
    number: Column, text: Column, identity: Column, options: Column | None = None, correct: Column | None = None, distinct: Column | None = None,
) -> Column:
    """Identity of a question by its place in a paper or, where ``identity`` is "content", by its text.

    By place it needs a number, else it is null; a sitting (``shift``) is part of the place only. Where
    ``distinct`` is true the shape, ``options`` and ``correct`` as sorted sets, is part of it too.
    """
    head = F.concat_ws("-", *[_component(F.upper(F.trim(c))) for c in (exam, variant, _period(year, session), subject)])
    digits = number.cast("string")
    place = F.concat(F.lit("-Q"), F.when(F.length(digits) > 3, digits).otherwise(F.lpad(digits, 3, "0")))
    sitting = F.when(F.coalesce(shift, F.lit("")) != "", F.concat(F.lit("-"), _component(F.upper(F.trim(shift))))).otherwise(F.lit(""))
    content = F.concat(F.lit("-C"), F.upper(F.substring(F.sha2(normalize_text(text).cast("binary"), 256), 1, 16)))
    own = F.concat(head, F.when(identity == "content", content).otherwise(F.concat(sitting, place)))
    if distinct is None:
        return own
    shape = F.concat(F.array_join(options, "\x1f"), F.lit("\x1e"), F.array_join(correct, "\x1f"))
    return F.when(distinct, F.concat(own, F.lit("-D"), F.upper(F.substring(F.sha2(shape.cast("binary"), 256), 1, 8)))).otherwise(own)


def question_set_slug(exam: Column, variant: Column, year: Column, session: Column, subject: Column, shift: Column) -> Column:
    parts = [exam, variant, _period(year, session), subject, F.nullif(shift, F.lit(""))]
    return F.concat_ws("-", *[_component(F.lower(c)) for c in parts])


def _issue(condition: Column, severity: str, code: str, message: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(message).alias("message")))


def quality_issues(questions: DataFrame, exams: DataFrame | None = None, order: list[str] | None = None) -> DataFrame:
    """Add ``issues``, an array of (severity, code, message), and ``valid``: no issue is an error.

    Questions have question_text, question_type, options (key, text), correct_keys, answer_text,
    answer_status, explanation, needs_review, media (placement, option_key), exam_slug, stable_id and
    number. With ``order``, which tells rows apart, a stable id that an earlier numbered row has is an error as well.
    """
    q = questions
    if exams is not None:
        q = q.join(exams.select(F.col("slug").alias("exam_slug"), F.lit(True).alias("_registered")).distinct(), "exam_slug", "left")
    else:
        q = q.withColumn("_registered", F.lit(True))
    if order:
        place = F.struct(*order)
        first = questions.where("number is not null").groupBy("stable_id").agg(F.min(place).alias("_first"))
        q = q.join(first, "stable_id", "left").withColumn("_repeat", F.col("number").isNotNull() & (place > F.col("_first"))).drop("_first")
    else:
        q = q.withColumn("_repeat", F.lit(False))
    keys = F.transform("options", lambda o: o["key"])
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    choice = F.col("question_type").isin("mcq", "multiple_correct")
    unanswered = (F.size(F.coalesce("correct_keys", F.array().cast("array<string>"))) == 0) & blank(F.col("answer_text"))
    on_option = F.filter(F.coalesce(F.col("media"), F.array().cast(q.schema["media"].dataType)), lambda m: m["placement"] == "option")
    off_option = F.filter(F.coalesce(F.col("media"), F.array().cast(q.schema["media"].dataType)), lambda m: m["placement"] != "option")
    rules = [
        _issue(blank(F.col("question_text")), "error", "MISSING_QUESTION_TEXT", "The question has no text"),
        _issue(choice & (F.size("options") < 2), "error", "MCQ_MISSING_OPTIONS", "A choice question needs two options"),
        _issue(F.size(F.array_distinct(keys)) < F.size(keys), "error", "DUPLICATE_OPTION_KEYS", "Two options share a key"),
        _issue((F.col("answer_status") == "scored") & unanswered, "error", "MISSING_ANSWER", "A scored question has no answer"),
        _issue(F.exists(on_option, lambda m: ~F.coalesce(F.array_contains(keys, m["option_key"]), F.lit(False))), "error", "MEDIA_OPTION_NOT_FOUND", "An image is for an option that is not there"),
        _issue(F.exists(off_option, lambda m: m["option_key"].isNotNull()), "error", "MEDIA_OPTION_KEY_MISPLACED", "An image outside options has an option key"),
        _issue(choice & (F.size(F.array_except("correct_keys", keys)) > 0), "error", "INVALID_ANSWER_KEY", "The answer is not an option"),
        _issue(blank(F.col("explanation")), "warning", "MISSING_EXPLANATION", "The question has no explanation"),
        _issue(F.coalesce(F.col("needs_review"), F.lit(False)) | F.contains(F.coalesce("question_text", F.lit("")), F.lit("FLAG FOR HUMAN REVIEW")), "error", "NEEDS_REVIEW", "The question is marked for review"),
        _issue(F.col("_registered").isNull(), "error", "EXAM_NOT_REGISTERED", "The exam is not registered"),
        _issue(F.col("_repeat"), "error", "DUPLICATE_STABLE_CONTENT_ID", "An earlier question has the same identity"),
    ]
    q = q.withColumn("issues", F.array_compact(F.array(*rules))).drop("_registered", "_repeat")
    return q.withColumn("valid", ~F.exists("issues", lambda i: i["severity"] == "error"))


def confidence(valid: Column, source_type: Column) -> Column:
    return F.when(~valid, "low").when(source_type == "official", "high").otherwise("medium")


def find_or_create(existing: DataFrame, wanted: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """The dimension with the natural keys it lacked, under ids that their keys determine."""
    fresh = wanted.select(*keys).distinct().withColumn(id_col, F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]).cast("binary"), 256))
    return insert_absent(existing.select(*keys, id_col), fresh, keys, null_safe=True)


def register_chain(levels: list[tuple[DataFrame, list[str]]], wanted: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Find or create a chain of dimensions, each below the one before: organisation, type, exam, variant, session.

    A level is its table (id, parent_id and its natural keys) and those keys, which ``wanted`` has too. Returns
    the tables with what they lacked, and ``wanted`` with the ``id`` of its last level.
    """
    rows, found = wanted.withColumn("parent_id", F.lit(None).cast("string")), []
    for existing, keys in levels:
        whole = find_or_create(existing, rows, ["parent_id", *keys])
        found.append(whole)
        ids = whole.select(F.col("parent_id").alias("_parent"), *[F.col(k).alias(f"_{k}") for k in keys], "id")
        same = F.col("parent_id").eqNullSafe(F.col("_parent"))
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        rows = rows.join(ids, same).select(*wanted.columns, F.col("id").alias("parent_id"))
    return found, rows.withColumnRenamed("parent_id", "id")


def normalize_extracted(extracted: DataFrame) -> DataFrame:
    """Extracted questions as normalised ones: id, question_text, question_type, options (key, text), correct_keys, negative_marks.

    Extracted ones have id, question_text, option_texts, answer (a letter, several, or an option's text) and marks.
    Options are lettered in order; a choice question with one right option loses a third of its marks.
    """
    letter = lambda i: F.char(F.lit(65) + i)
    texts = F.coalesce("option_texts", F.array().cast("array<string>"))
    options = F.transform(texts, lambda t, i: F.struct(letter(i).alias("key"), F.trim(t).alias("text")))
    named = F.filter(F.split(F.upper(F.regexp_replace("answer", r"[\s,;]+", "")), ""), lambda k: k != "")
    as_keys = F.col("answer").rlike(r"^\s*[A-Za-z](\s*[,;]\s*[A-Za-z])*\s*$")
    by_text = F.transform(F.filter("options", lambda o: F.lower(o["text"]) == F.lower(F.trim("answer"))), lambda o: o["key"])
    known = F.transform("options", lambda o: o["key"])
    rows = extracted.withColumn("options", options)
    keys = F.array_sort(F.array_intersect(F.when(as_keys, named).otherwise(by_text), known))
    rows = rows.withColumn("correct_keys", F.coalesce(keys, F.array().cast("array<string>")))
    kind = F.when(F.size("options") == 0, "text").when(F.size("correct_keys") > 1, "multiple_correct").otherwise("mcq")
    return rows.select("id", "question_text", kind.alias("question_type"), "options", "correct_keys", F.when(kind == "mcq", F.round(F.col("marks") / 3, 2)).alias("negative_marks"))


def upsert_question_sets(sets: DataFrame, incoming: DataFrame) -> DataFrame:
    """Question sets by slug; a key status only moves forward."""
    forward = key_rank(F.col("new.key_status")) > key_rank(F.col("old.key_status"))
    return merge_upsert(sets, incoming, ["slug"], update=["key_status"], condition=forward)


def answer_rows(questions: DataFrame) -> DataFrame:
    """One row per correct option, text or numeric range of (id, type, correct_keys, answer_text, ranges)."""
    none = F.lit(None)
    keys = questions.where(F.col("type").isin("mcq", "multiple_correct")).select(
        "id", F.explode("correct_keys").alias("option_key"), none.cast("string").alias("text_answer"),
        none.cast("double").alias("numeric_min"), none.cast("double").alias("numeric_max"), none.cast("int").alias("range_group"))
    ranges = questions.where("type = 'numerical'").select("id", F.posexplode("ranges").alias("range_group", "r")).select(
        "id", none.cast("string").alias("option_key"), none.cast("string").alias("text_answer"),
        F.col("r.lo").alias("numeric_min"), F.col("r.hi").alias("numeric_max"), "range_group")
    texts = questions.where("type = 'text'").select(
        "id", none.cast("string").alias("option_key"), F.col("answer_text").alias("text_answer"),
        none.cast("double").alias("numeric_min"), none.cast("double").alias("numeric_max"), none.cast("int").alias("range_group"))
    return keys.unionByName(ranges).unionByName(texts)


def upsert_occurrences(occurrences: DataFrame, incoming: DataFrame) -> DataFrame:
    """Occurrences by (question_id, question_set_id): facts are updated only where they differ.

    Marks are rounded to two places before they are compared, and kept whole, however many digits they have. New ones without a number
    go on from the set's largest.
    """
    incoming = incoming.withColumns({c: F.round(c, 2).cast("decimal(38,2)") for c in ("marks", "negative_marks")})
    keys, facts = ["question_id", "question_set_id"], ["marks", "negative_marks", "answer_status"]
    differ = F.lit(False)
    for c in facts:
        differ = differ | ~F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}"))
    known = occurrences.select(*keys).withColumn("_known", F.lit(True))
    marked = incoming.join(known, keys, "left")
    fresh = append_numbered(occurrences, marked.where("_known is null").drop("_known"), "question_set_id", ["question_id"], "number")
    again = marked.where("_known").drop("_known")
    return merge_upsert(occurrences, fresh.select(occurrences.columns).unionByName(again.select(occurrences.columns)), keys, update=facts, condition=differ)


def link_variants(variants: DataFrame, linked: DataFrame) -> DataFrame:
    """Remember further wordings (question_id, content_hash, text) of existing questions, once each."""
    return insert_absent(variants, linked, ["question_id", "content_hash"])


def resolve_questions(incoming: DataFrame, stored: DataFrame, order: list[str], hold_if_taken: bool = False) -> DataFrame:
    """What question each incoming one becomes: id, action, question, stable_id.

    Incoming ones have id, stable_id, distinct_id, existing (the stored question that duplicates name)
    and force_new; stored ones id and stable_id. A named question is linked. A stable id that another
    question has is a position taken, which is held or fails; with ``force_new`` the question takes its
    distinct id, or is linked to the question that has it already. Of incoming ones that would create
    the same id the first by ``order`` does, and for the others it is taken.
    """
    by_id = lambda name: stored.select(F.col("stable_id").alias(name), F.col("id").alias(f"_{name}"))
    rows = incoming.join(by_id("stable_id"), "stable_id", "left").join(by_id("distinct_id"), "distinct_id", "left")
    force, taken = F.coalesce("force_new", F.lit(False)), F.col("_stable_id").isNotNull()
    linked = F.when(~force, F.col("existing")).when(taken, F.col("_distinct_id"))
    own = F.when(force & taken, F.col("distinct_id")).otherwise(F.col("stable_id"))
    refused = F.lit("held" if hold_if_taken else "failed")
    action = F.when(linked.isNotNull(), "linked").when(taken & ~force, refused).otherwise("created")
    rows = rows.select("id", *[c for c in order if c != "id"], linked.alias("_linked"), own.alias("_own"), action.alias("_action"), F.col("_stable_id").alias("_taken_by"))
    first = rows.where("_action = 'created'").groupBy("_own").agg(F.min(F.struct(*[c for c in order if c != "id"], "id")).alias("_first"))
    rows = rows.join(first, "_own", "left")
    later = (F.col("_action") == "created") & (F.col("id") != F.col("_first.id"))
    return rows.select(
        "id", F.when(later, refused).otherwise(F.col("_action")).alias("action"),
        F.coalesce("_linked", F.when(F.col("_action").isin("held", "failed"), F.col("_taken_by"))).alias("question"), F.col("_own").alias("stable_id"),
    )


def reword_questions(questions: DataFrame, options: DataFrame, variants: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Questions, options and variants after reviewers preferred new versions, and the (id, error) that cannot be used.

    Questions have id, question_text, text_format, explanation; options id, question_id, position,
    option_key, option_text; variants question_id, content_hash, text; new versions id, question_text, text_format,
    explanation and options (key, text). Option ids stay and take the new texts in order, so their
    number must be the same. An explanation is kept where the new version has none, escaped if it was
    plain and the text now is Markdown. The old wording becomes a variant, and the new one is none any more.
    """
    from ..functions.richtext import escape_markdown

    counts = options.groupBy(F.col("question_id").alias("id")).agg(F.count("*").alias("_n"))
    checked = chosen.join(questions.select("id", F.lit(True).alias("_known")), "id", "left").join(counts, "id", "left")
    error = F.when(F.col("_known").isNull(), "the question does not exist").when(F.coalesce("_n", F.lit(0)) != F.size("options"), "another number of options")
    checked = checked.withColumn("error", error)
    good = checked.where("error is null").select("id", F.struct("question_text", "text_format", "explanation", "options").alias("new"))
    both = questions.join(good, "id", "left")
    has, is_new = F.col("new").isNotNull(), F.col("new.explanation").isNull()
    plain = (F.col("text_format") == "plain") & (F.col("new.text_format") == "markdown")
    kept = F.when(plain, escape_markdown(F.col("explanation"))).otherwise(F.col("explanation"))
    reworded = both.select(
        "id", F.when(has, F.col("new.question_text")).otherwise(F.col("question_text")).alias("question_text"),
        F.when(has, F.col("new.text_format")).otherwise(F.col("text_format")).alias("text_format"),
        F.when(has & ~is_new, F.col("new.explanation")).when(has, kept).otherwise(F.col("explanation")).alias("explanation"),
    )
    place = F.row_number().over(W.partitionBy("question_id").orderBy("position", "id"))
    ranked = options.withColumn("_place", place).join(good.select(F.col("id").alias("question_id"), "new.options"), "question_id", "left")
    option = F.get("options", F.col("_place") - 1)
    new_options = ranked.select("id", "question_id", "position", F.coalesce(option["key"], "option_key").alias("option_key"), F.coalesce(option["text"], "option_text").alias("option_text"))
    old_norm, new_norm = normalize_text(F.col("question_text")), normalize_text(F.col("new.question_text"))
    changed = both.where(has & (old_norm != new_norm)).select("id", F.col("question_text").alias("text"), content_hash(old_norm).alias("content_hash"), content_hash(new_norm).alias("_now"))
    left = variants.join(changed.select(F.col("id").alias("question_id"), F.col("_now").alias("content_hash")), ["question_id", "content_hash"], "left_anti")
    more = changed.select(F.col("id").alias("question_id"), "content_hash", "text")
    return reworded, new_options, link_variants(left.select("question_id", "content_hash", "text"), more), checked.where("error is not null").select("id", "error")


def review_answer_keys(options: Column, answer: Column) -> Column:
    """Keys A, B, ... of the options that an answer text names; null where some part matches none.

    The whole text is tried first, then its parts between " | ". Case and white space do not count.
    """
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    texts = F.transform(options, plain)
    place = lambda a: F.array_position(texts, plain(a)).cast("int")
    letter = lambda p: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), 1, 26).substr(p, F.lit(1))
    parts = F.transform(F.split(answer, r" \| "), place)
    whole = place(answer)
    keys = F.array_sort(F.array_distinct(F.transform(parts, letter)))
    return F.when(whole > 0, F.array(letter(whole))).when(~F.exists(parts, lambda p: p == 0), keys)


def publish_batch(questions: DataFrame, decisions: DataFrame) -> DataFrame:
    """What becomes of each question (id, valid): rejected, linked, held, skipped or created."""
    d = decisions.select(F.col("probe").alias("id"), "outcome", "existing")
    action = (
        F.when(~F.col("valid"), "rejected").when(F.col("outcome").isin("same", "remembered_same"), "linked")
        .when(F.col("outcome") == "remembered_skipped", "skipped").when(F.col("outcome").isin("conflicting", "near"), "held").otherwise("created")
    )
    return questions.join(d, "id", "left").select("id", action.alias("action"), "existing")


def batch_status(actions: DataFrame, batch: str) -> DataFrame:
    """Status of each review batch from the actions on its questions."""
    held, bad, good = (F.count_if(F.col("action").isin(*x)) for x in (("held",), ("rejected",), ("linked", "created", "skipped")))
    status = F.when(held > 0, "needs_decisions").when(good == 0, "not_approved").otherwise("approved")
    return actions.groupBy(batch).agg(good.alias("published"), held.alias("held"), bad.alias("failed"), status.alias("status"))
