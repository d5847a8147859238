"""Joins and browse views over the order star."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import catalog
from .registry import query, table


@query("""
SELECT l_orderkey, l_linenumber, n_name, r_name, p_name, s_name
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
LEFT JOIN part ON l_partkey = p_partkey AND p_size > 25 LEFT JOIN supplier ON l_suppkey = s_suppkey
WHERE o_orderstatus = 'F'
""")
def star_occurrences(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    rows = catalog.star(
        t("lineitem"),
        [(t("orders").where("o_orderstatus = 'F'"), "l_orderkey", "o_orderkey"), (t("customer"), "o_custkey", "c_custkey"), (t("nation"), "c_nationkey", "n_nationkey"), (t("region"), "n_regionkey", "r_regionkey")],
        [(t("part").where("p_size > 25"), "l_partkey", "p_partkey"), (t("supplier"), "l_suppkey", "s_suppkey")],
    )
    return rows.select("l_orderkey", "l_linenumber", "n_name", "r_name", "p_name", "s_name")


@query("""
SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS has_urgent,
  (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders
FROM customer
""")
def exists_mark(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max((F.col("o_orderpriority") == "1-URGENT")).alias("urgent"))
    rows = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", F.coalesce("urgent", F.lit(False)).alias("has_urgent"), F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("""
SELECT 'with' AS side, count(*) AS n, coalesce(round(sum(c_acctbal), 2), 0) AS balance FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL
SELECT 'without', count(*), coalesce(round(sum(c_acctbal), 2), 0) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
""")
def semi_anti(spark, sf_dir):
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    total = [F.count("*").alias("n"), F.coalesce(F.round(F.sum("c_acctbal"), 2), F.lit(0.0)).alias("balance")]
    sides = [customers.join(orders, "c_custkey", how).agg(*total).withColumn("side", F.lit(s)) for s, how in (("with", "left_semi"), ("without", "left_anti"))]
    return sides[0].unionByName(sides[1])


@query("""
SELECT l_orderkey, '[' || string_agg('{"l_linenumber":' || l_linenumber || ',"l_partkey":' || l_partkey || ',"l_returnflag":"' || l_returnflag || '"}', ',' ORDER BY l_linenumber, l_partkey, l_returnflag) || ']' AS lines
FROM lineitem GROUP BY l_orderkey
""")
def collect_ordered_json(spark, sf_dir):
    return catalog.ordered_json(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_returnflag"], ["l_linenumber", "l_partkey", "l_returnflag"], "lines")


@query("""
SELECT n_name AS exam, list_aggregate(list_sort(list_distinct(list(c_mktsegment) FILTER (c_acctbal > 0))), 'string_agg', ',') AS subjects, min(c_custkey) AS first_id
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name
""")
def collect_distinct_filtered(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    found = F.array_join(F.array_sort(F.collect_set(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")))), ",")
    return rows.groupBy(F.col("n_name").alias("exam")).agg(F.when(found != "", found).alias("subjects"), F.min("c_custkey").alias("first_id"))


@query("""
SELECT o_orderkey, o_totalprice, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50
""")
def top_by_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("o_orderkey", "o_totalprice", "c_name").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(50)


@query("""
SELECT 'https://example.org/orders/' || o_orderkey AS loc, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS lastmod
FROM orders WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
""")
def sitemap_entries(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = table(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "published").otherwise("draft"))
    pages = catalog.published(orders).join(returned, "o_orderkey", "left_semi")
    return catalog.sitemap_entries(pages, "https://example.org/", F.concat(F.lit("/orders/"), "o_orderkey"), F.col("o_orderdate"))


@query("""
SELECT 'https://example.org/d/' || o_orderkey AS link, o_orderdate AS published_at,
  '<item><title>' || o_orderpriority || '</title><link>https://example.org/d/' || o_orderkey || '</link><pubDate>'
  || strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate><description><![CDATA[' || o_orderstatus || ']]></description></item>' AS item
FROM orders ORDER BY o_orderdate DESC, link LIMIT 50
""")
def rss_items(spark, sf_dir):
    link = F.concat(F.lit("https://example.org/d/"), F.col("o_orderkey"))
    return catalog.rss_items(table(spark, sf_dir, "orders"), F.col("o_orderpriority"), link, F.col("o_orderstatus"), F.col("o_orderdate"))


@query("""
SELECT o_custkey, c_mktsegment AS subject, count(*) AS n, min(o_orderdate) AS first_seen,
  rank() OVER (PARTITION BY c_mktsegment ORDER BY min(o_orderdate), o_custkey) AS position
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
""")
def subjects_first_seen(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counts = rows.groupBy("o_custkey", F.col("c_mktsegment").alias("subject")).agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first_seen"))
    return counts.withColumn("position", F.rank().over(W.partitionBy("subject").orderBy("first_seen", "o_custkey")).cast("long"))


@query("""
SELECT n_name AS key, coalesce(s.enabled, n_nationkey % 2 = 0) AS enabled
FROM nation LEFT JOIN (SELECT s_nationkey, bool_or(s_acctbal > 5000) AS enabled FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey
""")
def feature_flags(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    defaults = nation.select(F.col("n_name").alias("key"), (F.col("n_nationkey") % 2 == 0).alias("enabled"))
    stored = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.max(F.col("s_acctbal") > 5000).alias("enabled"))
    stored = stored.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("key"), "enabled")
    return catalog.flag_states(defaults, stored)


@query("""
WITH n AS (SELECT c_custkey, c_name, lower(regexp_replace(trim(c_name), '[^a-zA-Z0-9]+', '-', 'g')) AS slug FROM customer)
SELECT c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN slug ELSE 'seg-' || c_custkey % 7 END AS slug FROM n
""")
def match_registered(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    names = customers.select(F.col("c_name").alias("name"), F.concat(F.lit("https://x.org/seg-"), F.col("c_custkey") % 7, F.lit("/")).alias("url"))
    from ..functions.text import slugify

    by_slug = customers.where("c_custkey % 2 = 0").select(slugify(F.col("c_name")).alias("slug"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("url_pattern"))
    seg = (F.col("c_custkey") % 7).cast("string")
    by_url = customers.select(F.concat(F.lit("seg-"), seg).alias("slug"), F.lit(None).cast("string").alias("code"), F.concat(F.lit("/seg-"), seg, F.lit("/")).alias("url_pattern")).distinct()
    return catalog.match_registered(names, by_slug.unionByName(by_url)).select("name", "slug")
