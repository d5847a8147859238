"""Publishing many review batches as if one question after another, in a few rounds over all of them.

A question is checked against everything that stood before it: what is stored, and what earlier questions of
its batch and of earlier batches have created. One by one that would be a job for each question, and in waves of
questions that resemble no earlier one a job for each link of the longest chain. Only a question that is *created* can
stand in the way of later ones, though: those with its text, a similar one, or its place in a
paper. So each round creates every open question that comes before all open ones that it would stand in the way
of, stores them, and closes those; what is created is what the one-by-one order creates. A group of thousands of copies
takes two rounds. All similar texts are found once, before the rounds, which see ids and digests alone.

Then every question is decided in one pass against what is stored and what earlier ones have created, and the
questions, occurrences and media of those that are created or linked are stored.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import normalize_text, text_digest
from ..storage import stored
from .merge import insert_absent
from .publish import upsert_occurrences
from .similarity import similar_pairs


@dataclass(frozen=True)
class Store:
    """questions (id, stable_id, text, options, answers), variants (question_id, text), occurrences (question_id,
    question_set_id, number, marks, negative_marks, answer_status) and media (question_id, storage_key, position)."""

    questions: DataFrame
    variants: DataFrame
    occurrences: DataFrame
    media: DataFrame


def _digest(text: Column) -> Column:
    return text_digest(normalize_text(text))


def _created(rows: DataFrame, near: DataFrame) -> DataFrame:
    """(id, place, d, stable_id, round) of what gets created, of open ``rows`` (id, place, d, stable_id); ``near`` has (d, other) both ways."""
    reach = lambda some: some.select("d").unionByName(near.join(some.select(F.col("d").alias("other")), "other").select("d")).distinct()
    found, n, left = [], 0, stored(rows, "open")
    while left.head(1):
        n += 1
        first = left.groupBy("d").agg(F.min("place").alias("first"))
        around = first.unionByName(near.join(first.withColumnRenamed("d", "other"), "other").select("d", "first"))
        around = around.groupBy("d").agg(F.min("first").alias("first_text"))
        taken = left.where("stable_id is not null").groupBy("stable_id").agg(F.min("place").alias("first_id"))
        chosen = left.join(around, "d").join(taken, "stable_id", "left").where((F.col("place") == F.col("first_text")) & (F.col("place") == F.coalesce("first_id", "place")))
        chosen = stored(chosen.select(rows.columns).withColumn("round", F.lit(n)), "created")
        found.append(chosen)
        left = left.join(chosen.select("id"), "id", "left_anti").join(reach(chosen), "d", "left_anti")
        left = stored(left.join(chosen.select("stable_id"), "stable_id", "left_anti").select(rows.columns), "open")
    return reduce(DataFrame.unionByName, found) if found else rows.withColumn("round", F.lit(0)).where("false")


def publish_in_order(incoming: DataFrame, store: Store, threshold: float = 0.9) -> tuple[DataFrame, Store]:
    """(id, batch, action, outcome, question, similarity, round, added) of every incoming question, and the store afterwards.

    Incoming ones have id, batch, position, text, options and answers (sorted sets), stable_id, question_set, number, marks,
    negative_marks, answer_status, media (array of storage_key, position) and valid; ids are of the type of the store's, and a created question keeps its own. They are taken by
    batch, position and id. Actions: rejected (not valid), linked (outcome same), held (conflicting: the text with another shape; near: the
    most similar one; position: another text's place) or created (unique). ``added`` tells whether the question is new to its
    set. Facts of an occurrence are those of the last question for it, its number that of the first.
    """
    place = F.struct("batch", "position", "id").alias("place")
    rows = stored(incoming.select("id", place, "batch", "stable_id", "options", "answers", "valid", "question_set", normalize_text(F.col("text")).alias("norm"))
                  .withColumn("d", text_digest(F.col("norm"))), "incoming")
    texts = stored(rows.where("valid and norm is not null").groupBy("d").agg(F.first("norm").alias("text")), "texts")
    q = store.questions.select("id", "text", "options", "answers")
    wordings = q.unionByName(store.variants.select(F.col("question_id").alias("id"), F.col("text").alias("wording")).join(q, "id").select("id", F.col("wording").alias("text"), "options", "answers"))
    known = stored(wordings.select("id", "options", "answers", normalize_text(F.col("text")).alias("norm")).where("norm is not null").withColumn("d", text_digest(F.col("norm"))), "known")
    known_texts = known.groupBy("d").agg(F.first("norm").alias("text"))
    keyed = lambda df: df.select(F.col("d").alias("id"), "text")
    scores = [F.col("similarity"), F.col("trigram")]
    pairs = stored(similar_pairs(keyed(texts), None, threshold).select("a", "b", *scores), "pairs")
    near = pairs.select(F.col("a").alias("d"), F.col("b").alias("other"), *scores).unionByName(pairs.select(F.col("b").alias("d"), F.col("a").alias("other"), *scores))
    near_known = stored(similar_pairs(keyed(texts), keyed(known_texts), threshold).select(F.col("a").alias("d"), F.col("b").alias("other"), *scores), "near")
    open_rows = rows.where("valid and norm is not null").select("id", "place", "d", "stable_id")
    open_rows = open_rows.join(known.select("d").unionByName(near_known.select("d")).distinct(), "d", "left_anti")
    open_rows = open_rows.join(store.questions.where("stable_id is not null").select("stable_id").distinct(), "stable_id", "left_anti").select("id", "place", "d", "stable_id")
    created = stored(_created(open_rows, near.select("d", "other")), "all-created")

    new = rows.join(created.select("id", "round"), "id").select("id", "d", "options", "answers", "stable_id", F.col("place").alias("since"))
    never = F.lit(None).cast(rows.schema["place"].dataType).alias("since")
    standing = known.select("id", "d", "options", "answers", never).unionByName(new.drop("stable_id"))
    # of a text and shape the first one is enough, unless it came later than the question
    standing = standing.groupBy("d", "options", "answers", "since").agg(F.min("id").alias("existing"))
    before = F.col("since").isNull() | (F.col("since") < F.col("place"))
    mine = rows.where("valid").select("id", "place", "d", "options", "answers", "stable_id")
    same = F.col("options").eqNullSafe(F.col("eo")) & F.col("answers").eqNullSafe(F.col("ea"))
    exact = mine.join(standing.select("d", F.col("options").alias("eo"), F.col("answers").alias("ea"), "since", "existing"), "d").where(before)
    exact = exact.groupBy("id").agg(F.max(F.struct(same.alias("same"), (F.col("since").isNull()).alias("old"))).alias("_best"), F.min_by("existing", F.struct(~same, F.col("since").isNotNull(), "existing")).alias("exact"))
    by_text = standing.groupBy("d", "since").agg(F.min("existing").alias("existing"))
    alike = near_known.withColumn("new", F.lit(False)).unionByName(near.withColumn("new", F.lit(True)))
    alike = alike.join(by_text.withColumnRenamed("d", "other"), "other").where(F.col("new") == F.col("since").isNotNull())
    close = mine.select("id", "place", "d").join(alike, "d").where(before)
    close = close.groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), (-F.col("trigram")).alias("t"), "existing")).alias("near"))
    places = store.questions.where("stable_id is not null").select("stable_id", F.col("id").alias("existing"), never).unionByName(new.select("stable_id", F.col("id").alias("existing"), "since").where("stable_id is not null"))
    taken = mine.select("id", "place", "stable_id").join(places, "stable_id").where(before).groupBy("id").agg(F.min("existing").alias("holder"))
    found = rows.select("id", "batch", "place", "valid", "question_set", "norm").join(created.select("id", "round"), "id", "left").join(exact, "id", "left").join(close, "id", "left").join(taken, "id", "left")
    outcome = (
        F.when(F.col("round").isNotNull(), "unique").when(~F.coalesce("valid", F.lit(False)) | F.col("norm").isNull(), "invalid").when(F.col("_best.same"), "same")
        .when(F.col("exact").isNotNull(), "conflicting").when(F.col("near").isNotNull(), "near").otherwise("position")
    )
    action = F.when(outcome == "unique", "created").when(outcome == "invalid", "rejected").when(outcome == "same", "linked").otherwise("held")
    question = F.when(outcome == "unique", F.col("id")).when(outcome != "invalid", F.coalesce("exact", "near.existing", "holder"))
    similarity = F.when(F.col("exact").isNotNull(), 1.0).otherwise(-F.col("near.s"))
    actions = found.select("id", "batch", "place", "question_set", action.alias("action"), outcome.alias("outcome"), question.alias("question"), F.when(outcome.isin("same", "conflicting", "near"), similarity).alias("similarity"), "round")
    actions = stored(actions, "actions")

    published = actions.where(F.col("action").isin("created", "linked")).select("id", "place", "question", "question_set").join(
        incoming.select("id", "number", "marks", "negative_marks", "answer_status", "media"), "id")
    both = published.groupBy(F.col("question").alias("question_id"), F.col("question_set").alias("question_set_id")).agg(
        F.min_by("number", "place").alias("number"), *[F.max_by(c, "place").alias(c) for c in ("marks", "negative_marks", "answer_status")], F.min_by("id", "place").alias("_first"))
    fresh = both.join(store.occurrences.select("question_id", "question_set_id"), ["question_id", "question_set_id"], "left_anti").select(F.col("_first").alias("id"), F.lit(True).alias("added"))
    occurrences = upsert_occurrences(store.occurrences, both.drop("_first").select(store.occurrences.columns))
    media = published.select(F.col("question").alias("question_id"), "place", F.inline("media"))
    media = media.groupBy("question_id", "storage_key").agg(F.min_by("position", "place").alias("position")).select(store.media.columns)
    added = incoming.join(actions.where("action = 'created'").select("id"), "id").select("id", "stable_id", "text", "options", "answers")
    after = replace(store, questions=store.questions.unionByName(added), occurrences=occurrences, media=insert_absent(store.media, media, ["question_id", "storage_key"]))
    report = actions.join(fresh, "id", "left").select("id", "batch", "action", "outcome", "question", "similarity", "round", F.coalesce("added", F.lit(False)).alias("added"))
    return report, after


def missing_media(incoming: DataFrame, stored_keys: DataFrame) -> DataFrame:
    """The storage keys that have to be uploaded before valid questions are published, once each."""
    return incoming.where("valid").select(F.explode("media.storage_key").alias("storage_key")).distinct().join(stored_keys, "storage_key", "left_anti")


def batch_reports(actions: DataFrame, intake: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Each batch's counts and status, and one audit row for it (entity_id, action, new_value).

    A batch is approved when every question is published or skipped; with one that was rejected it is not
    approved, with one held it waits for decisions, and both leave it in the queue. Publishing again changes nothing.
    """
    n = lambda *x: F.count_if(F.col("action").isin(*x))
    counts = actions.groupBy("batch").agg(
        n("created", "linked").alias("published"), F.count_if("added").alias("added"), n("held").alias("held"), n("rejected").alias("failed"))
    counts = counts.withColumn("already_in_set", F.col("published") - F.col("added"))
    status = F.when(F.col("failed") > 0, "not_approved").when(F.col("held") > 0, "needs_decisions").otherwise("approved")
    counts = counts.withColumn("status", status)
    kind = F.when(F.col("status") == "approved", "approve").when(F.col("status") == "not_approved", "approve_failed").otherwise("approve_held")
    audit = counts.select(F.col("batch").alias("entity_id"), kind.alias("action"), F.to_json(F.struct("added", "already_in_set", "failed", "held", "published", "status")).alias("new_value"))
    return counts, audit


def mirrored_intake(actions: DataFrame, intake: DataFrame, order: list[str]) -> DataFrame:
    """Intake items (id, status, question_id) after a publish: published with their question, rejected where skipped, otherwise as they were."""
    first = F.row_number().over(W.partitionBy("id").orderBy(*order))
    known = actions.withColumn("_n", first).where("_n = 1").select("id", "action", "question")
    both = intake.join(known, "id", "left")
    done = F.col("action").isin("created", "linked")
    status = F.when(done, "published").when(F.col("action") == "skipped", "rejected").otherwise(F.col("status"))
    return both.select("id", status.alias("status"), F.when(done, F.col("question")).otherwise(F.col("question_id")).alias("question_id"))
