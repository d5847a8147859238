"""Usage analytics: event counts, failure and completion rates, top entities, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import text_digest


def since_days(df: DataFrame, at: str, days: int, anchor: Column | None = None) -> DataFrame:
    """Rows of the last ``days`` days before ``anchor``, by default the latest row of the table."""
    anchor = df.agg(F.max(at)).scalar() if anchor is None else anchor
    return df.where(F.col(at) >= anchor - F.expr(f"INTERVAL {days} DAYS"))


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def rate(hits: Column, total: Column) -> Column:
    """A share that is 0 where nothing was counted."""
    return F.when(total > 0, hits / total).otherwise(F.lit(0.0))


def filtered_rate(df: DataFrame, condition: Column, *keys: str) -> DataFrame:
    """Rows, rows that meet the condition and their share."""
    total, hits = F.count("*"), F.count_if(condition)
    return df.groupBy(*keys).agg(total.alias("total"), hits.alias("hits"), rate(hits, total).alias("rate"))


def funnel(df: DataFrame, event: str, started: str, completed: str, *keys: str) -> DataFrame:
    a, b = F.count_if(F.col(event) == started), F.count_if(F.col(event) == completed)
    return df.groupBy(*keys).agg(a.alias("started"), b.alias("completed"), rate(b, a).alias("completion_rate"))


def top_entities(df: DataFrame, entity: str, limit: int) -> DataFrame:
    """The most frequent entities. Rows without one can take a place, and are dropped after the limit."""
    ranked = df.groupBy(entity).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first(entity)).limit(limit)
    return ranked.where(F.col(entity).isNotNull())


def session_scores(answers: DataFrame, session: str, status: Column, answered: Column, correct: Column) -> DataFrame:
    """Score per session over scored questions: skipped = total - attempted, percent of attempted."""
    scored = status == "scored"
    total, attempted, right = F.count_if(scored), F.count_if(scored & answered), F.count_if(scored & answered & correct)
    return answers.groupBy(session).agg(
        total.alias("total"), attempted.alias("attempted"), right.alias("correct"), (attempted - right).alias("incorrect"),
        (total - attempted).alias("skipped"),
        F.when(attempted > 0, F.round(100 * right / attempted)).otherwise(F.lit(0.0)).alias("percent"),
        F.count_if(~scored).alias("not_scored"),
    )


def novelty(batch: DataFrame, existing: DataFrame, text: str) -> DataFrame:
    """Distinct texts of a batch by whether they exist already, by their digests; blanks do not count."""
    digest = text_digest(F.col(text)).alias("digest")
    own = batch.where(F.col(text) != "").select(digest).distinct()
    known = existing.where(F.col(text) != "").select(digest).distinct().withColumn("_known", F.lit(True))
    return own.join(known, "digest", "left").agg(F.count_if(F.col("_known").isNull()).alias("new_count"), F.count_if(F.col("_known")).alias("existing_count"))


def rule_counts(df: DataFrame, rules: dict[str, Column], *keys: str) -> DataFrame:
    """One row per rule that some row breaks, with the number of rows."""
    counted = df.groupBy(*keys).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(r) for r, c in rules.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in rules]))
    return counted.select(*keys, pairs.alias("_p")).select(*keys, "_p.rule", "_p.n").where("n > 0")


def issue_counts(items: DataFrame, keys: list[str], issues: str) -> DataFrame:
    """Items with each code in their JSON array of issues: keys, code, n; a code counts once for an item."""
    codes = F.array_distinct(F.transform(F.from_json(issues, "array<struct<code:string>>"), lambda i: i["code"]))
    return items.select(*keys, F.explode(codes).alias("code")).groupBy(*keys, "code").agg(F.count("*").alias("n"))


def status_and_issue_summary(items: DataFrame, keys: list[str], status: str, issues: str, held: str) -> DataFrame:
    """keys, total, by_status and by_issue: counts as maps, of issues over the items in status ``held``."""
    as_map = lambda name: F.map_from_entries(F.collect_list(F.struct(name, "n")))
    by_status = items.groupBy(*keys, status).agg(F.count("*").alias("n"))
    by_status = by_status.groupBy(*keys).agg(F.sum("n").alias("total"), as_map(status).alias("by_status"))
    by_issue = issue_counts(items.where(F.col(status) == held), keys, issues).groupBy(*keys).agg(as_map("code").alias("by_issue"))
    none = F.create_map().cast("map<string,bigint>")
    return by_status.join(by_issue, keys, "left").withColumn("by_issue", F.coalesce("by_issue", none))


def import_report(items: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of an import by ``keys``, in one pass over its items, whose sums must agree; a row that does not fails the job.

    Items have codes (their issues), rules (of the detector of mathematics), outcome (recovered, still_held, retypeset, kept), reasons,
    issues_after and math_runs. One is ready without a code and flagged with a rule; a flagged one is recovered or still held, and of the
    others with runs of mathematics each is re-typeset or kept. Histograms are maps; held ones are counted by their codes, in order, joined by "+".
    """
    some = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0
    flagged, done = some("rules"), F.coalesce(F.col("outcome"), F.lit(""))
    typed = ~flagged & F.coalesce(F.col("math_runs"), F.lit(False))
    counts = {
        "questions": F.lit(True), "ready": ~some("codes"), "held": some("codes"), "flagged": flagged, "flagged_math_only": flagged & (F.col("codes") == F.array(F.lit("math"))),
        "recovered": flagged & (done == "recovered"), "recovered_now_ready": flagged & (done == "recovered") & ~some("issues_after"), "still_held": flagged & (done == "still_held"),
        "clean_with_math_runs": typed, "retypeset": typed & (done == "retypeset"), "kept": typed & (done == "kept"),
    }
    totals = items.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    sets = F.array_join(F.array_sort(F.array_distinct("codes")), "+")
    kinds = [
        ("held_by_issues", some("codes"), F.array(sets)), ("by_detector_rule", flagged, F.array_distinct("rules")),
        ("still_held_by_reason", counts["still_held"], F.array_distinct("reasons")), ("kept_by_reason", counts["kept"], F.array_distinct("reasons")),
    ]
    named = F.flatten(F.array(*[_tagged(*k) for k in kinds]))
    histogram = items.select(*keys, F.inline(named)).groupBy(*keys, "kind", "value").agg(F.count("*").alias("n"))
    maps = histogram.groupBy(*keys).agg(*[
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("value", "n"))))).alias(kind) for kind, _, _ in kinds])
    none = F.create_map().cast("map<string,bigint>")
    both = totals.join(maps, keys, "left").withColumns({kind: F.coalesce(kind, none) for kind, _, _ in kinds})
    return reconciled(both, {"recovered + still_held <> flagged": F.col("recovered") + F.col("still_held") == F.col("flagged"),
                             "retypeset + kept <> clean_with_math_runs": F.col("retypeset") + F.col("kept") == F.col("clean_with_math_runs")})


def _tagged(kind: str, when: Column, values: Column) -> Column:
    rows = F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    return F.when(when, rows).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))


def reconciled(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows, failing the job at one that breaks a rule, with the rule's name."""
    first = df.columns[0]
    broken = F.lit(None).cast("string")
    for name, rule in rules.items():
        broken = F.when(F.coalesce(rule, F.lit(False)), broken).otherwise(F.lit(f"the counts don't add up: {name}"))
    return df.withColumn("_broken", broken).withColumn(first, F.when(F.col("_broken").isNotNull(), F.raise_error(F.col("_broken")).cast(df.schema[first].dataType)).otherwise(F.col(first))).drop("_broken")


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """The same rows, whose metrics are gathered in the pass that writes them."""
    own = Observation(name)
    return df.observe(own, *[m.alias(n) for n, m in metrics.items()]), own


def reconcile(own: Observation, total: str, *parts: str) -> dict[str, int]:
    """The metrics of a pass that has run; an error if the parts are not the total."""
    found = own.get
    if sum(found[p] for p in parts) != found[total]:
        raise ValueError(f"the counts don't add up: {' + '.join(f'{p} {found[p]}' for p in parts)} is not {total} {found[total]}")
    return found
