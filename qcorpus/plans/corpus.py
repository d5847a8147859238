"""Keyed writes, change detection, intake and queue state over the orders and pages tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle, merge
from .registry import query, table


def _split_orders(spark, sf_dir):
    """Orders as a stored table (two thirds of the keys) and an incoming batch (two thirds as well)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    target = orders.where("o_orderkey % 3 <> 0").withColumn("o_totalprice", F.floor("o_totalprice").cast("double"))
    return target, orders.where("o_orderkey % 3 <> 1")


_SPLIT = """
WITH t AS (SELECT o_orderkey, o_orderstatus, floor(o_totalprice) AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 0),
s AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 1)
"""


@query(_SPLIT + """
SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, coalesce(s.o_orderstatus, t.o_orderstatus) AS o_orderstatus,
  CASE WHEN s.o_orderkey IS NULL THEN t.o_totalprice ELSE s.o_totalprice END AS o_totalprice
FROM t FULL OUTER JOIN s ON t.o_orderkey = s.o_orderkey
""")
def merge_upsert(spark, sf_dir):
    target, source = _split_orders(spark, sf_dir)
    return merge.merge_upsert(target, source, ["o_orderkey"])


@query(_SPLIT + """
SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, coalesce(t.o_orderstatus, s.o_orderstatus) AS o_orderstatus,
  CASE WHEN t.o_orderkey IS NULL THEN s.o_totalprice WHEN s.o_orderkey IS NOT NULL AND t.o_orderstatus = 'O' AND s.o_totalprice IS DISTINCT FROM t.o_totalprice
    THEN s.o_totalprice ELSE t.o_totalprice END AS o_totalprice
FROM t FULL OUTER JOIN s ON t.o_orderkey = s.o_orderkey
""")
def conditional_upsert(spark, sf_dir):
    target, source = _split_orders(spark, sf_dir)
    condition = (F.col("old.o_orderstatus") == "O") & ~F.col("new.o_totalprice").eqNullSafe(F.col("old.o_totalprice"))
    return merge.merge_upsert(target, source, ["o_orderkey"], update=["o_totalprice"], condition=condition)


@query(_SPLIT + """
SELECT * FROM t UNION ALL SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.o_orderkey IS NOT DISTINCT FROM s.o_orderkey)
""")
def insert_absent(spark, sf_dir):
    target, source = _split_orders(spark, sf_dir)
    return merge.insert_absent(target, source, ["o_orderkey"], null_safe=True)


@query("""
WITH t AS (SELECT o_custkey, max(o_orderkey % 50) AS top FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1),
s AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey END AS number FROM orders WHERE o_orderkey % 3 <> 0)
SELECT o_custkey, o_orderkey, coalesce(number, coalesce(top, 0) + row_number() OVER (PARTITION BY o_custkey, number IS NULL ORDER BY o_orderkey)) AS number
FROM s LEFT JOIN t USING (o_custkey)
""")
def append_numbered(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    target = orders.where("o_orderkey % 3 = 0").withColumn("number", F.col("o_orderkey") % 50)
    source = orders.where("o_orderkey % 3 <> 0").withColumn("number", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey")))
    return merge.append_numbered(target, source, "o_custkey", ["o_orderkey"], "number")


@query("""
WITH t AS (SELECT o_orderpriority, max(o_orderkey % 50) AS top FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1),
s AS (SELECT o_orderpriority, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey END AS number FROM orders WHERE o_orderkey % 3 <> 0)
SELECT o_orderpriority, o_orderkey, coalesce(number, coalesce(top, 0) + row_number() OVER (PARTITION BY o_orderpriority, number IS NULL ORDER BY o_orderkey)) AS number
FROM s LEFT JOIN t USING (o_orderpriority)
""")
def append_numbered_all(spark, sf_dir):
    """As append_numbered, within five large groups."""
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey")
    target = orders.where("o_orderkey % 3 = 0").withColumn("number", F.col("o_orderkey") % 50)
    source = orders.where("o_orderkey % 3 <> 0").withColumn("number", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey")))
    return merge.append_numbered(target, source, "o_orderpriority", ["o_orderkey"], "number")


@query("""
WITH h AS (SELECT page_id, sha256(html) AS sha256 FROM pages)
SELECT sha256, min(page_id) AS page_id FROM h WHERE page_id % 2 = 1 AND sha256 NOT IN (SELECT sha256 FROM h WHERE page_id % 2 = 0) GROUP BY sha256
""")
def content_addressed(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    stored = pages.where("page_id % 2 = 0").select(F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))
    fresh = merge.content_addressed(stored, pages.where("page_id % 2 = 1"), "html").select("sha256")
    hashed = pages.where("page_id % 2 = 1").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))
    return fresh.join(hashed, "sha256").groupBy("sha256").agg(F.min("page_id").alias("page_id"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'present'
  WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'copy' ELSE 'missing' END AS action
FROM customer
""")
def copy_missing(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return merge.copy_missing(table(spark, sf_dir, "customer"), orders.where("o_orderstatus = 'F'"), orders, "c_custkey")


@query("""
SELECT count(*) FILTER (ts >= m.last - INTERVAL 7 DAYS) AS kept, count(*) FILTER (ts < m.last - INTERVAL 7 DAYS) AS pruned
FROM events, (SELECT max(ts) AS last FROM events) m
""")
def retention_prune(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kept, gone = merge.prune(events, "ts", 7, events.agg(F.max("ts")).scalar())
    return kept.agg(F.count("*").alias("kept")).select("kept", gone.agg(F.count("*")).scalar().alias("pruned"))


_CRAWLS = """
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS source, url, sha256(html) AS h FROM pages),
stored AS (SELECT source, url, CASE WHEN page_id % 4 = 0 THEN sha256('old') ELSE h END AS sha256, page_id AS fetched_at FROM p WHERE page_id % 5 <> 0),
fetched AS (SELECT source, url, h AS sha256, CASE WHEN page_id % 6 = 0 THEN 304 ELSE 200 END AS http_status, page_id FROM p WHERE page_id % 7 <> 0 OR page_id % 5 = 0)
"""


def _crawls(spark, sf_dir):
    """Two crawls of the pages: what was stored by the first, and what the second fetched."""
    source = F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("source")
    pages = table(spark, sf_dir, "pages").select("page_id", source, "url", F.sha2(F.col("html").cast("binary"), 256).alias("h"))
    old = F.sha2(F.lit("old").cast("binary"), 256)
    stored = pages.where("page_id % 5 <> 0").select("source", "url", F.when(F.col("page_id") % 4 == 0, old).otherwise(F.col("h")).alias("sha256"), F.col("page_id").alias("fetched_at"))
    status = F.when(F.col("page_id") % 6 == 0, 304).otherwise(200)
    return stored, pages.where("page_id % 7 <> 0 or page_id % 5 = 0").select("source", "url", F.col("h").alias("sha256"), status.alias("http_status"), "page_id")


@query(_CRAWLS + """
, last AS (SELECT DISTINCT ON (source, url) source, url, sha256 AS last FROM stored ORDER BY source, url, fetched_at DESC, sha256 DESC)
SELECT page_id, CASE WHEN http_status = 304 THEN 'unchanged' WHEN last IS NULL THEN 'new' WHEN last = sha256 THEN 'unchanged' ELSE 'changed' END AS change
FROM fetched LEFT JOIN last USING (source, url)
""")
def change_classify(spark, sf_dir):
    stored, fetched = _crawls(spark, sf_dir)
    return lifecycle.classify_changes(stored, fetched).select("page_id", "change")


@query(_CRAWLS + """
, removed AS (SELECT source, url, CASE WHEN min(page_id) % 3 = 0 THEN 'confirmed_removed' ELSE 'ignored' END AS status FROM p WHERE page_id % 8 = 0 GROUP BY 1, 2),
seen AS (SELECT DISTINCT source, url, true AS seen FROM fetched),
gone AS (SELECT DISTINCT source, url FROM stored EXCEPT SELECT source, url FROM seen)
SELECT source, url, CASE WHEN status IS NULL THEN 'flagged' WHEN seen AND status IN ('flagged', 'confirmed_removed') THEN 'restored' ELSE status END AS status
FROM removed FULL OUTER JOIN gone USING (source, url) LEFT JOIN seen USING (source, url)
""")
def removed_reconcile(spark, sf_dir):
    stored, fetched = _crawls(spark, sf_dir)
    source = F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("source")
    first = table(spark, sf_dir, "pages").where("page_id % 8 = 0").groupBy(source, "url").agg(F.min("page_id").alias("p"))
    removed = first.select("source", "url", F.when(F.col("p") % 3 == 0, "confirmed_removed").otherwise("ignored").alias("status"))
    return lifecycle.reconcile_removed(stored, fetched, removed)


@query("""
WITH d AS (SELECT doc_id, md5(text) AS h FROM documents),
stored AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE h END AS content_hash,
  CASE doc_id % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'in_review' WHEN 2 THEN 'published' ELSE 'dismissed' END AS status FROM d WHERE doc_id % 3 <> 0),
items AS (SELECT doc_id, h AS content_hash, CASE WHEN doc_id % 2 = 0 THEN 'ready' ELSE 'held' END AS status FROM d)
SELECT doc_id, CASE WHEN s.status = 'in_review' THEN s.content_hash ELSE i.content_hash END AS content_hash,
  CASE WHEN s.status IS NULL THEN i.status WHEN s.status = 'in_review' THEN s.status
    WHEN s.content_hash = i.content_hash AND s.status IN ('published', 'dismissed') THEN s.status ELSE i.status END AS status,
  CASE WHEN s.status IS NULL THEN 'inserted' WHEN s.status = 'in_review' THEN 'waiting' WHEN s.content_hash = i.content_hash THEN 'unchanged' ELSE 'changed' END AS result
FROM items i LEFT JOIN stored s USING (doc_id)
""")
def intake_transition(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    kind = F.col("doc_id") % 4
    status = F.when(kind == 0, "ready").when(kind == 1, "in_review").when(kind == 2, "published").otherwise("dismissed")
    stored = docs.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("h")).alias("content_hash"), status.alias("status"))
    items = docs.select("doc_id", F.col("h").alias("content_hash"), F.when(F.col("doc_id") % 2 == 0, "ready").otherwise("held").alias("status"))
    return lifecycle.record_intake(stored, items, ["doc_id"])


@query("""
SELECT l.doc_id AS id, CASE WHEN quality = 1 AND toxic = 0 AND doc_id % 5 < 4 THEN
    CASE doc_id % 5 WHEN 0 THEN 'same' WHEN 1 THEN 'same_new' WHEN 2 THEN 'different' ELSE 'skipped' END
  WHEN quality = 1 THEN 'pending' ELSE 'different' END AS status,
  toxic = 0 AND NOT (quality = 1 AND doc_id % 5 < 4) AS rejected
FROM labels l
""")
def resolve_duplicates(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    pending = labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "pending").otherwise("different").alias("status"))
    kind = F.col("doc_id") % 5
    decision = F.when(kind == 0, "same").when(kind == 1, "same_new").when(kind == 2, "different").when(kind == 3, "skip").otherwise("nonsense")
    return lifecycle.resolve_duplicate(pending, labels.where("toxic = 0").select(F.col("doc_id").alias("id"), decision.alias("decision")))


@query("""
SELECT s_suppkey, s_nationkey, sha256(s_nationkey::VARCHAR) AS variant_id FROM supplier
""")
def find_or_create_dimension(spark, sf_dir):
    from ..operators.publish import find_or_create

    suppliers = table(spark, sf_dir, "supplier")
    existing = suppliers.where("s_nationkey % 2 = 0").select("s_nationkey").distinct().withColumn("id", F.sha2(F.col("s_nationkey").cast("string").cast("binary"), 256))
    ids = find_or_create(existing, suppliers, ["s_nationkey"]).withColumnRenamed("id", "variant_id")
    return suppliers.join(ids, "s_nationkey").select("s_suppkey", "s_nationkey", "variant_id")
