"""Analytics over the event, order and conversation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics, catalog, lifecycle
from .registry import query, table


def _recent_events(spark: SparkSession, sf_dir: str, days: int) -> DataFrame:
    return analytics.since_days(table(spark, sf_dir, "events"), "ts", days)


@query("""
SELECT event_type, count(*) AS n FROM events
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAYS GROUP BY event_type
""")
def event_counts_10d(spark, sf_dir):
    return analytics.counts_by(_recent_events(spark, sf_dir, 10), "event_type")


@query("""
SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS hits,
  count(*) FILTER (event_type = 'error') / count(*)::DOUBLE AS rate
FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAYS GROUP BY user_id
""")
def failure_rate_by_user(spark, sf_dir):
    return analytics.filtered_rate(_recent_events(spark, sf_dir, 10), F.col("event_type") == "error", "user_id")


@query("""
SELECT date_trunc('day', ts)::DATE AS day, count(*) FILTER (event_type = 'view') AS started,
  count(*) FILTER (event_type = 'purchase') AS completed,
  CASE WHEN count(*) FILTER (event_type = 'view') > 0
    THEN count(*) FILTER (event_type = 'purchase') / count(*) FILTER (event_type = 'view')::DOUBLE ELSE 0 END AS completion_rate
FROM events GROUP BY 1
""")
def daily_funnel(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return analytics.funnel(events, "event_type", "view", "purchase", "day")


@query("""
SELECT entity, n FROM (
  SELECT CASE WHEN event_type = 'view' THEN json_extract_string(props, '$.k') END AS entity, count(*) AS n
  FROM events GROUP BY 1 ORDER BY n DESC, entity NULLS FIRST LIMIT 10
) WHERE entity IS NOT NULL
""")
def top_viewed_entities(spark, sf_dir):
    entity = F.when(F.col("event_type") == "view", F.get_json_object("props", "$.k"))
    return analytics.top_entities(table(spark, sf_dir, "events").select(entity.alias("entity")), "entity", 10)


@query("""
SELECT o_orderpriority, count(*) FILTER (o_orderdate > m.last - INTERVAL 90 DAYS) AS recent_jobs,
  count(*) FILTER (o_orderdate > m.last - INTERVAL 90 DAYS AND o_orderstatus = 'F') AS recent_failures,
  CASE WHEN count(*) FILTER (o_orderdate > m.last - INTERVAL 90 DAYS) > 0 THEN
    count(*) FILTER (o_orderdate > m.last - INTERVAL 90 DAYS AND o_orderstatus = 'F')
    / count(*) FILTER (o_orderdate > m.last - INTERVAL 90 DAYS)::DOUBLE END AS error_rate,
  round(avg(o_totalprice), 4) AS avg_runtime_ms,
  count(*) FILTER (o_orderdate > m.last - INTERVAL 90 DAYS AND o_orderstatus = 'F') >= 2 AS degraded
FROM orders, (SELECT max(o_orderdate) AS last FROM orders) m GROUP BY o_orderpriority, m.last
""")
def source_health(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    jobs = orders.withColumn("status", F.when(F.col("o_orderstatus") == "F", "failed").otherwise("completed"))
    found = lifecycle.source_health(jobs, "o_orderpriority", "o_orderdate", F.col("status"), F.col("o_totalprice"), 90, orders.agg(F.max("o_orderdate")).scalar())
    return found.withColumn("avg_runtime_ms", F.round("avg_runtime_ms", 4))


@query("""
SELECT c.c_nationkey AS nation, count(*) AS orders, count(DISTINCT o_custkey) AS customers
FROM orders JOIN customer c ON o_custkey = c_custkey GROUP BY c.c_nationkey
""")
def counts_by_dimension(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"))


@query("""
SELECT o_orderpriority AS paper, o_orderstatus AS status, count(*) AS n, sum(count(*)) OVER (PARTITION BY o_orderpriority)::BIGINT AS total
FROM orders GROUP BY 1, 2
""")
def status_rollup(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("paper"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("paper").agg(F.sum("n").alias("total"))
    return counts.join(totals, "paper")


@query("""
WITH s AS (
  SELECT user_id, ts, event_id, event_type AS stage, CASE WHEN user_id % 2 = 1 THEN 'completed' WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'running' ELSE 'completed' END AS status,
    CASE WHEN event_type = 'click' AND user_id % 3 = 0 THEN event_id % 2 ELSE 0 END AS failed_items FROM events
), j AS (
  SELECT user_id, count(*) AS stages, count(*) FILTER (status = 'completed') AS done, max(failed_items) AS most,
    string_agg(stage || ': ' || event_id, '; ' ORDER BY ts, event_id) FILTER (status = 'failed') AS errors,
    string_agg(stage || ': ' || failed_items || ' item(s) failed', '; ' ORDER BY ts, event_id) FILTER (failed_items > 0) AS items
  FROM s GROUP BY user_id
), t AS (SELECT *, CASE WHEN done = 0 THEN 'failed' WHEN done = stages AND most = 0 THEN 'completed' ELSE 'partial' END AS status FROM j)
SELECT user_id, stages, status, coalesce(errors, CASE WHEN status = 'partial' THEN items END) AS error_summary FROM t
""")
def job_finalize(spark, sf_dir):
    """A user's events as the stages of a job: of even users errors failed and sign-ups still run, some clicks left an item behind."""
    kind = F.col("event_type")
    status = F.when(F.col("user_id") % 2 == 1, "completed").when(kind == "error", "failed").when(kind == "signup", "running").otherwise("completed")
    left = F.when((kind == "click") & (F.col("user_id") % 3 == 0), F.col("event_id") % 2).otherwise(0)
    stages = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job"), F.struct("ts", "event_id").alias("position"), kind.alias("stage"), status.alias("status"),
        left.alias("failed_items"), F.when(status == "failed", F.col("event_id").cast("string")).alias("error"),
    )
    return lifecycle.finalize_jobs(stages).withColumnRenamed("job", "user_id")


def _issue_items(spark, sf_dir):
    """Orders as intake items, the flags and modes of their lines as a JSON array of issues."""
    issue = F.transform(F.col("flags"), lambda f: F.struct(F.lower(f).alias("code"), F.lit("x").alias("detail")))
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list("l_returnflag")).alias("flags"))
    items = table(spark, sf_dir, "orders").join(per, "o_orderkey", "left")
    return items.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("paper"), F.col("o_orderstatus").alias("status"), F.to_json(issue).alias("issues"))


#: The same in DuckDB: each order's issues as a JSON array.
_ITEMS_SQL = """
WITH f AS (SELECT l_orderkey, to_json(list({'code': lower(l_returnflag), 'detail': 'x'})) AS issues FROM lineitem GROUP BY 1),
i AS (SELECT o_orderkey AS id, o_orderpriority AS paper, o_orderstatus AS status, issues FROM orders LEFT JOIN f ON l_orderkey = o_orderkey),
u AS (SELECT DISTINCT id, paper, status, code FROM (SELECT id, paper, status, unnest(from_json(issues, '[{"code":"VARCHAR"}]')).code AS code FROM i))
"""


@query(_ITEMS_SQL + "SELECT paper, code, count(*) AS n FROM u WHERE status = 'F' GROUP BY 1, 2")
def issue_unnest_counts(spark, sf_dir):
    """Why held items are held: the codes in their JSON arrays of issues, each once for an item."""
    return analytics.issue_counts(_issue_items(spark, sf_dir).where("status = 'F'"), ["paper"], "issues")


@query(_ITEMS_SQL + """,
s AS (SELECT paper, sum(n)::BIGINT AS total, string_agg(status || ':' || n, ',' ORDER BY status) AS by_status FROM (SELECT paper, status, count(*) AS n FROM i GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT paper, string_agg(code || ':' || n, ',' ORDER BY code) AS by_issue FROM (SELECT paper, code, count(*) AS n FROM u WHERE status = 'F' GROUP BY 1, 2) GROUP BY 1)
SELECT paper, total, by_status, by_issue FROM s LEFT JOIN c USING (paper)
""")
def intake_summary(spark, sf_dir):
    """Per paper the items in each status, and those held for each issue."""
    found = analytics.status_and_issue_summary(_issue_items(spark, sf_dir), ["paper"], "status", "issues", "F")
    told = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return found.select("paper", "total", told("by_status").alias("by_status"), F.nullif(told("by_issue"), F.lit("")).alias("by_issue"))


@query(_ITEMS_SQL + "SELECT paper, count(*) AS items, sum(json_array_length(issues))::BIGINT AS issues FROM i GROUP BY 1")
def issue_array_lengths(spark, sf_dir):
    """The lengths of JSON arrays, summed by paper."""
    items = _issue_items(spark, sf_dir)
    return items.groupBy("paper").agg(F.count("*").alias("items"), F.sum(F.json_array_length("issues")).alias("issues"))


@query("""
WITH j AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'completed' END AS status, o_orderpriority AS job_type,
  CASE WHEN o_custkey % 5 > 0 THEN 'r' || o_custkey % 5 END AS run_id, o_orderdate AS created_at FROM orders),
q AS (SELECT *, CASE WHEN status = 'running' AND job_type = '1-URGENT' AND run_id IS NOT NULL THEN 'queued' ELSE status END AS s1 FROM j),
c AS (SELECT *, CASE WHEN s1 = 'queued' AND run_id = 'r2' THEN 'cancelled' ELSE s1 END AS s2 FROM q),
n AS (SELECT id FROM c WHERE s2 = 'queued' AND job_type = '2-HIGH' AND run_id IS NOT NULL ORDER BY created_at, id LIMIT 1)
SELECT id, CASE WHEN id IN (FROM n) THEN 'running' ELSE s2 END AS status FROM c
""")
def job_queue_steps(spark, sf_dir):
    """A worker starts again: interrupted jobs are requeued, a run is cancelled, and the next job is claimed."""
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
    jobs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderpriority").alias("job_type"),
        F.when(F.col("o_custkey") % 5 > 0, F.concat(F.lit("r"), (F.col("o_custkey") % 5).cast("string"))).alias("run_id"), F.lit(0).alias("run_position"),
        F.col("o_orderdate").alias("created_at"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"), F.lit(None).cast("string").alias("error_summary"))
    now = F.lit("2024-01-01").cast("timestamp")
    jobs = lifecycle.cancel_run(lifecycle.requeue_interrupted(jobs, "1-URGENT"), "r2", now)
    return lifecycle.claim_next(jobs, "2-HIGH", now).select("id", "status")


@query("""
WITH e AS (SELECT user_id AS job, event_type AS stage, min(epoch_us(ts) // 1000) AS began, max(epoch_us(ts) // 1000) AS ended, arg_max(event_id, (epoch_ms(ts), event_id)) AS last FROM events GROUP BY 1, 2)
SELECT job, stage, CASE WHEN last % 3 = 0 THEN 'running' ELSE 'completed' END AS status, CASE WHEN last % 3 > 0 THEN ended - began END AS duration_ms FROM e
""")
def stage_timing(spark, sf_dir):
    """The stages of jobs from their events: the last one tells the state, and how long the stage took."""
    status = F.when(F.col("event_id") % 3 == 0, "running").otherwise("completed")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    order = F.struct(at, "event_id")
    events = table(spark, sf_dir, "events")
    last = events.groupBy("user_id", "event_type").agg(F.max(order).alias("last"))
    rows = events.join(last, ["user_id", "event_type"]).withColumn("status", F.when(order == F.col("last"), status).otherwise("running"))
    events = rows.select(
        F.col("user_id").alias("job"), F.col("event_type").alias("stage"), at.alias("at_ms"), "status",
        F.lit(0).alias("failed_items"), F.lit(None).cast("string").alias("error"))
    none = spark.createDataFrame([], "job long, stage string, status string, failed_items int, error string, duration_ms long")
    return lifecycle.record_stages(none, events).select("job", "stage", "status", "duration_ms")


@query("""
WITH last AS (SELECT user_id, max((ts, event_id)) FILTER (event_type <> 'error') AS ok FROM events GROUP BY user_id)
SELECT user_id, count(*) FILTER (event_type = 'error' AND (ok IS NULL OR (ts, event_id) > ok)) AS consecutive_failures
FROM events JOIN last USING (user_id) GROUP BY user_id
""")
def trailing_failures(spark, sf_dir):
    return lifecycle.trailing_failures(table(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") != "error", "event_id")


@query("""
SELECT DISTINCT ON (user_id) user_id, event_id, event_type, value FROM events ORDER BY user_id, value DESC NULLS LAST, event_id
""")
def distinct_on_latest(spark, sf_dir):
    rows = catalog.latest_per_key(table(spark, sf_dir, "events"), ["user_id"], [F.desc_nulls_last("value"), F.col("event_id")])
    return rows.select("user_id", "event_id", "event_type", "value")


@query("""
SELECT json_extract_string(props, '$.k') AS k, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2
""")
def json_field_counts(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return events.groupBy("k", "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("""
SELECT coalesce(json_extract_string(props, '$.k'), 'e' || event_id) AS run, min(ts) AS started_at, count(*) AS jobs,
  count(*) FILTER (event_type IN ('view', 'purchase')) AS completed, count(*) FILTER (event_type = 'error') AS failed,
  count(*) FILTER (event_type IN ('click', 'signup')) AS open
FROM events GROUP BY 1 ORDER BY started_at DESC, run LIMIT 20
""")
def scrape_runs(spark, sf_dir):
    # The state that stands for each event type
    state = F.create_map(*[F.lit(x) for x in ("view", "completed", "purchase", "partial", "error", "failed", "click", "queued", "signup", "running")])
    jobs = table(spark, sf_dir, "events").select(
        F.get_json_object("props", "$.k").alias("run_id"), F.concat(F.lit("e"), "event_id").alias("id"), F.col("ts").alias("created_at"),
        F.try_element_at(state, F.col("event_type")).alias("status"),
    )
    return lifecycle.scrape_runs(jobs, 20)


@query("""
SELECT DISTINCT ON (o_orderpriority) o_orderpriority AS queue, o_orderkey FROM orders
WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey
""")
def next_in_queue(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "O", "queued").otherwise("completed"))
    jobs = jobs.withColumnRenamed("o_orderpriority", "queue")
    return lifecycle.next_in_queue(jobs, "queue", ["o_orderdate", "o_orderkey"]).select("queue", "o_orderkey")


@query("""
WITH a AS (SELECT l_orderkey, l_returnflag <> 'R' AS scored, l_linestatus = 'F' AS answered, l_discount > 0.04 AS correct FROM lineitem)
SELECT l_orderkey, count(*) FILTER (scored) AS total, count(*) FILTER (scored AND answered) AS attempted,
  count(*) FILTER (scored AND answered AND correct) AS correct, count(*) FILTER (scored AND answered AND NOT correct) AS incorrect,
  count(*) FILTER (scored AND NOT answered) AS skipped,
  CASE WHEN count(*) FILTER (scored AND answered) > 0
    THEN round(100 * count(*) FILTER (scored AND answered AND correct) / count(*) FILTER (scored AND answered)::DOUBLE) ELSE 0 END AS percent,
  count(*) FILTER (NOT scored) AS not_scored
FROM a GROUP BY l_orderkey
""")
def session_scores(spark, sf_dir):
    status = F.when(F.col("l_returnflag") != "R", "scored").otherwise("cancelled")
    return analytics.session_scores(table(spark, sf_dir, "lineitem"), "l_orderkey", status, F.col("l_linestatus") == "F", F.col("l_discount") > 0.04)


@query("""
SELECT count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT user_id) AS users,
  (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM documents) AS documents
FROM events
""")
def dashboard_counts(spark, sf_dir):
    one = table(spark, sf_dir, "events").agg(
        F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("user_id").alias("users"))
    return one.select("*", *[table(spark, sf_dir, name).agg(F.count("*")).scalar().alias(name) for name in ("orders", "documents")])


@query("""
SELECT event_type, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END AS user_id,
  CASE WHEN user_id % 3 = 0 THEN 's' || user_id END AS session_id, count(*) AS n
FROM events GROUP BY ALL
""")
def event_attribution(spark, sf_dir):
    """Events belong to a user or, without one, to a session, never to both."""
    known = F.when(F.col("user_id") % 3 != 0, F.col("user_id"))
    session = F.when(known.isNull(), F.concat(F.lit("s"), F.col("user_id")))
    rows = table(spark, sf_dir, "events").select("event_type", known.alias("user_id"), session.alias("session_id"))
    return analytics.counts_by(rows, "event_type", "user_id", "session_id")
