"""Change detection, intake state, review decisions, jobs and source health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import latest_per_key
from .merge import merge_upsert


def classify_changes(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """new, changed or unchanged per fetched (source, url, sha256, http_status), against the latest artifact.

    ``stored`` has source, url, sha256 and fetched_at. A 304 answer is unchanged.
    """
    last = latest_per_key(stored, ["source", "url"], [F.desc("fetched_at"), F.desc("sha256")]).select("source", "url", F.col("sha256").alias("last_sha256"))
    state = (
        F.when(F.col("http_status") == 304, "unchanged").when(F.col("last_sha256").isNull(), "new")
        .when(F.col("last_sha256") == F.col("sha256"), "unchanged").otherwise("changed")
    )
    return fetched.join(last, ["source", "url"], "left").withColumn("change", state)


def reconcile_removed(known: DataFrame, discovered: DataFrame, removed: DataFrame) -> DataFrame:
    """New state of the removed resources (source, url, status).

    Known URLs that were not discovered are flagged; a status set by a person is kept; discovered ones
    are restored, but only from flagged or confirmed_removed.
    """
    seen = discovered.select("source", "url").distinct().withColumn("_seen", F.lit(True))
    gone = known.select("source", "url").distinct().join(seen, ["source", "url"], "left_anti").withColumn("_gone", F.lit(True))
    rows = removed.select("source", "url", "status").join(gone, ["source", "url"], "full_outer").join(seen, ["source", "url"], "left")
    status = (
        F.when(F.col("status").isNull(), "flagged")
        .when(F.col("_seen") & F.col("status").isin("flagged", "confirmed_removed"), "restored").otherwise(F.col("status"))
    )
    return rows.select("source", "url", status.alias("status"))


DECIDED = ("published", "dismissed")


def record_intake(stored: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """State of intake items after a parse, with what happened: inserted, changed, unchanged or waiting.

    Both have the keys, content_hash and status. Items in review are frozen (waiting); a decided
    status stays while the content does not change; a changed item takes the parse's status. Where
    ``stored`` tells by ``review_open`` that an item's review is over or gone, nothing holds it: it is ready.
    """
    status = F.col("status")
    if "review_open" in stored.columns:
        status = F.when((status == "in_review") & ~F.coalesce("review_open", F.lit(False)), "ready").otherwise(status)
    old = stored.select(*keys, F.col("content_hash").alias("old_hash"), status.alias("old_status"))
    new = items.select(*keys, "content_hash", "status")
    same = F.col("old_hash").eqNullSafe(F.col("content_hash"))
    reviewed = F.col("old_status") == "in_review"
    what = F.when(F.col("old_status").isNull(), "inserted").when(reviewed, "waiting").when(same, "unchanged").otherwise("changed")
    status = (
        F.when(F.col("old_status").isNull(), F.col("status")).when(reviewed, F.col("old_status"))
        .when(same & F.col("old_status").isin(*DECIDED), F.col("old_status")).otherwise(F.col("status"))
    )
    return new.join(old, keys, "left").select(
        *keys, F.when(reviewed, F.col("old_hash")).otherwise(F.col("content_hash")).alias("content_hash"), status.alias("status"), what.alias("result")
    )


def canonical_hash(*fields: str) -> Column:
    """SHA-256 of a row's fields as JSON, by name; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*[F.col(f) for f in sorted(fields)])).cast("binary"), 256)


def ready_for_batch(items: DataFrame, number: str = "number") -> DataFrame:
    """Ready items (status, review_batch_id) that are in no review batch yet, in order."""
    return items.where((F.col("status") == "ready") & F.col("review_batch_id").isNull()).orderBy(number)


def mark_in_review(items: DataFrame, chosen: DataFrame, batch: str) -> DataFrame:
    """Items (id, status, review_batch_id) of which the chosen ones (id) are now in a review batch."""
    return _set_jobs(items, chosen, F.lit(True), status=F.lit("in_review"), review_batch_id=F.lit(batch))


def sync_sources(sources: DataFrame, definitions: DataFrame) -> DataFrame:
    """Sources by name after a sync of their definitions (the static columns and ``onboarding``).

    What a source has done and whether it is enabled stays, but one that is not onboarded is never enabled.
    """
    out = F.coalesce(F.col("onboarding") == "not_onboarded", F.lit(False))
    new = definitions.withColumn("enabled", ~out)
    static = [c for c in definitions.columns if c not in ("name", "onboarding")]
    barred = F.when(~F.col("new.enabled"), F.lit(False)).otherwise(F.col("old.enabled"))
    return merge_upsert(sources, new.drop("onboarding"), ["name"], update=static, set_values={"enabled": barred})


def resolve_duplicate(pending: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply (id, decision) to reviews (id, status): only pending ones change, to an allowed decision."""
    d = decisions.select("id", "decision")
    valid = (F.col("status") == "pending") & F.col("decision").isin("same", "same_new", "different", "skip")
    now = F.when(valid, F.when(F.col("decision") == "skip", "skipped").otherwise(F.col("decision"))).otherwise(F.col("status"))
    return pending.join(d, "id", "left").select("id", now.alias("status"), (F.col("decision").isNotNull() & ~F.coalesce(valid, F.lit(False))).alias("rejected"))


def finalize_jobs(stages: DataFrame) -> DataFrame:
    """Status of each job from its stages (job, position, stage, status, failed_items, error).

    A job failed if no stage completed, and is completed if all did without a failed item; else it is
    partial. The summary joins the errors of failed stages in order, or without any, for a partial
    job, the numbers of failed items. A job has a bounded number of stages.
    """
    done, n, items = F.count_if(F.col("status") == "completed"), F.count("*"), F.coalesce("failed_items", F.lit(0))
    status = F.when(done == 0, "failed").when((done == n) & (F.count_if(items > 0) == 0), "completed").otherwise("partial")

    def joined(told: Column, what: Column) -> Column:
        parts = F.array_sort(F.collect_list(F.when(told, F.struct("position", F.concat("stage", F.lit(": "), what).alias("e")))))
        return F.nullif(F.array_join(F.transform(parts, lambda x: x["e"]), "; "), F.lit(""))

    errors = joined((F.col("status") == "failed") & (F.col("error") != ""), F.col("error"))
    counts = joined(items > 0, F.concat(items.cast("string"), F.lit(" item(s) failed")))
    return stages.groupBy("job").agg(n.alias("stages"), status.alias("status"), errors.alias("_errors"), counts.alias("_counts")).select(
        "job", "stages", "status", F.coalesce("_errors", F.when(F.col("status") == "partial", F.col("_counts"))).alias("error_summary")
    )


def start_jobs(jobs: DataFrame, started: DataFrame, at: Column) -> DataFrame:
    """Jobs (id, status, started_at) of which those in ``started`` (id) now run."""
    return _set_jobs(jobs, started, F.lit(True), status=F.lit("running"), started_at=at)


def requeue_interrupted(jobs: DataFrame, job_type: str) -> DataFrame:
    """Jobs of a run that were running when their worker stopped wait again."""
    stopped = (F.col("status") == "running") & (F.col("job_type") == job_type) & F.col("run_id").isNotNull()
    return _changed(jobs, stopped, status=F.lit("queued"), started_at=F.lit(None).cast("timestamp"))


def cancel_run(jobs: DataFrame, run_id: str, at: Column) -> DataFrame:
    """Jobs of a run that have not started are cancelled; those that run finish."""
    waiting = (F.col("status") == "queued") & (F.col("run_id") == run_id)
    return _changed(jobs, waiting, status=F.lit("cancelled"), completed_at=at, error_summary=F.lit("Cancelled before it started."))


def claim_next(jobs: DataFrame, job_type: str, at: Column) -> DataFrame:
    """Jobs after a worker has taken the oldest queued one of a run, by (created_at, run_position, id)."""
    order = F.struct("created_at", "run_position", "id")
    waiting = (F.col("status") == "queued") & (F.col("job_type") == job_type) & F.col("run_id").isNotNull()
    first = jobs.where(waiting).agg(F.min(order).alias("first")).select("first.id")
    return _set_jobs(jobs, first, waiting, status=F.lit("running"), started_at=at)


def record_stages(stages: DataFrame, events: DataFrame) -> DataFrame:
    """Stages (job, stage) from their events (job, stage, at_ms, status, failed_items, error): the last event tells, with the time since the first."""
    last = F.max_by(F.struct("status", "failed_items", "error"), F.struct("at_ms", "status"))
    took = F.when(F.col("last.status") != "running", F.col("ended") - F.col("began"))
    seen = events.groupBy("job", "stage").agg(F.min("at_ms").alias("began"), F.max("at_ms").alias("ended"), last.alias("last"))
    fresh = seen.select("job", "stage", "last.status", "last.failed_items", "last.error", took.alias("duration_ms"))
    return merge_upsert(stages, fresh.select(stages.columns), ["job", "stage"])


def _changed(jobs: DataFrame, where: Column, **values: Column) -> DataFrame:
    return jobs.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def _set_jobs(jobs: DataFrame, ids: DataFrame, where: Column, **values: Column) -> DataFrame:
    marked = jobs.join(ids.select(F.col("id"), F.lit(True).alias("_set")).distinct(), "id", "left")
    return _changed(marked, where & F.coalesce("_set", F.lit(False)), **values).select(jobs.columns)


def trailing_failures(attempts: DataFrame, key: str, at: str, success: Column, tie: str) -> DataFrame:
    """Failures since the last success per key, by (at, tie)."""
    marked = attempts.withColumn("_ok", F.coalesce(success, F.lit(False)))
    good = marked.where("_ok").groupBy(key).agg(F.max(F.struct(at, tie)).alias("_last"))
    rows = marked.join(good, key, "left")
    later = ~F.col("_ok") & (F.col("_last").isNull() | (F.struct(at, tie) > F.col("_last")))
    return rows.groupBy(key).agg(F.count_if(later).alias("consecutive_failures"))


def source_health(jobs: DataFrame, source: str, created: str, status: Column, runtime_ms: Column, days: int, now: Column, degraded_at: int = 2) -> DataFrame:
    """Recent jobs and failures, error rate (null without recent jobs), mean runtime of all time."""
    recent = F.col(created) > now - F.expr(f"INTERVAL {days} DAYS")
    n, bad = F.count_if(recent), F.count_if(recent & (status == "failed"))
    return jobs.groupBy(source).agg(
        n.alias("recent_jobs"), bad.alias("recent_failures"), F.when(n > 0, bad / n).alias("error_rate"),
        F.avg(runtime_ms).alias("avg_runtime_ms"), (bad >= degraded_at).alias("degraded"),
    )


def next_in_queue(jobs: DataFrame, queue: str, order: list[str]) -> DataFrame:
    """The oldest queued job of each queue."""
    return latest_per_key(jobs.where("status = 'queued'"), [queue], [F.col(c) for c in order])


def scrape_runs(jobs: DataFrame, limit: int = 20) -> DataFrame:
    """Newest runs: jobs grouped by run id, or by themselves, with a tally of their states."""
    run = F.coalesce("run_id", "id")
    done = F.col("status").isin("completed", "partial")
    return jobs.groupBy(run.alias("run")).agg(
        F.min("created_at").alias("started_at"), F.count("*").alias("jobs"), F.count_if(done).alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status").isin("queued", "running")).alias("open"),
    ).orderBy(F.desc("started_at"), "run").limit(limit)
