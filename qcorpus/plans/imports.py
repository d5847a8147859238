"""Import reports, text styles, pages of exams and definitions of sources, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers, text
from ..operators import analytics, catalog, layout, lifecycle
from ..sources import definitions
from ..storage import new_path
from .registry import query, table


def _told(counts):
    """A map of counts as text, by its keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), "|")


_ITEMS = """
WITH i AS (SELECT o_orderpriority AS paper, o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN ['figure'] ELSE [] END || CASE WHEN o_orderkey % 5 = 0 THEN ['layout'] ELSE [] END
  || CASE WHEN o_orderkey % 2 = 0 THEN ['math'] ELSE [] END AS codes FROM orders),
h AS (SELECT paper, array_to_string(codes, '+') AS v, count(*) AS n FROM i WHERE len(codes) > 0 GROUP BY 1, 2),
d AS (SELECT paper, v, count(*) AS n FROM (SELECT paper, unnest(CASE WHEN k % 4 = 0 THEN ['script', 'glyph'] ELSE ['script'] END) AS v FROM i WHERE k % 2 = 0) GROUP BY 1, 2),
s AS (SELECT paper, v, count(*) AS n FROM (SELECT paper, unnest(CASE WHEN k % 12 = 0 THEN ['no font', 'depth'] ELSE ['no font'] END) AS v FROM i WHERE k % 6 = 0) GROUP BY 1, 2)
SELECT paper, count(*) AS questions, count(*) FILTER (len(codes) = 0) AS ready, count(*) FILTER (len(codes) > 0) AS held, count(*) FILTER (k % 2 = 0) AS flagged,
  count(*) FILTER (k % 2 = 0 AND codes = ['math']) AS flagged_math_only, count(*) FILTER (k % 2 = 0 AND k % 6 <> 0) AS recovered, count(*) FILTER (k % 2 = 0 AND k % 6 <> 0 AND k % 10 <> 0) AS recovered_now_ready,
  count(*) FILTER (k % 6 = 0) AS still_held, count(*) FILTER (k % 2 = 1 AND k % 7 = 0) AS clean_with_math_runs, count(*) FILTER (k % 2 = 1 AND k % 7 = 0 AND k % 3 <> 0) AS retypeset,
  count(*) FILTER (k % 2 = 1 AND k % 21 = 0) AS kept,
  coalesce((SELECT string_agg(v || ':' || n, '|' ORDER BY v) FROM h WHERE h.paper = i.paper), '') AS held_by_issues, coalesce((SELECT string_agg(v || ':' || n, '|' ORDER BY v) FROM d WHERE d.paper = i.paper), '') AS by_detector_rule,
  coalesce((SELECT string_agg(v || ':' || n, '|' ORDER BY v) FROM s WHERE s.paper = i.paper), '') AS still_held_by_reason,
  CASE WHEN count(*) FILTER (k % 2 = 1 AND k % 21 = 0) > 0 THEN 'code:' || count(*) FILTER (k % 2 = 1 AND k % 21 = 0) ELSE '' END AS kept_by_reason
FROM i GROUP BY paper
"""


@query(_ITEMS)
def import_reports(spark, sf_dir):
    """Orders as imported questions with issues and outcomes of a rebuild of their mathematics: counts by paper, which must add up."""
    k = F.col("o_orderkey")
    some = lambda when, *values: F.when(when, F.array(*[F.lit(v) for v in values])).otherwise(F.array().cast("array<string>"))
    items = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("paper"), F.concat(some(k % 3 == 0, "figure"), some(k % 5 == 0, "layout"), some(k % 2 == 0, "math")).alias("codes"),
        F.concat(some(k % 2 == 0, "script"), some(k % 4 == 0, "glyph")).alias("rules"),
        F.when(k % 6 == 0, "still_held").when(k % 2 == 0, "recovered").when(k % 3 == 0, "kept").otherwise("retypeset").alias("outcome"),
        F.when(k % 6 == 0, F.concat(some(k % 6 == 0, "no font"), some(k % 12 == 0, "depth"))).otherwise(some(k % 3 == 0, "code")).alias("reasons"),
        some(k % 10 == 0, "layout").alias("issues_after"), (k % 7 == 0).alias("math_runs"))
    found = analytics.import_report(items, ["paper"])
    return found.withColumns({c: _told(F.col(c)) for c in ("held_by_issues", "by_detector_rule", "still_held_by_reason", "kept_by_reason")})


@query("""
WITH w AS (SELECT l_orderkey AS doc, l_linenumber AS n, l_partkey AS p, l_quantity::INT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS x FROM lineitem),
f AS (SELECT *, CASE q % 3 WHEN 0 THEN 'couriernew' WHEN 1 THEN 'cambriamath' ELSE 'dejavusansmono' END AS family FROM w),
c AS (SELECT doc, family, count(*) AS n FROM f GROUP BY 1, 2)
SELECT doc AS doc_id, string_agg(CASE WHEN p % 2 = 0 THEN 'fiAB12' ELSE 'plain' END, ' ' ORDER BY x) AS text, (SELECT arg_max(family, (c.n, family)) FROM c WHERE c.doc = f.doc) AS family,
  NOT bool_or(q = 50) AND 2 * count(*) FILTER (q % 3 <> 1) > count(*) AS code
FROM f GROUP BY doc
""")
def code_text_lines(spark, sf_dir):
    """The lines of an order as words of one text line: ligatures and full-width letters in plain forms, font families, and code by its fonts."""
    from pyspark.sql import Window as W

    q = F.col("l_quantity").cast("int")
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    font = F.when(q % 3 == 0, "BCDGEE+Courier New").when(q % 3 == 1, "XYZABC+Cambria Math").otherwise("DejaVu Sans Mono")
    words = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.lit(0).alias("line"), place.cast("double").alias("x0"), F.when(F.col("l_partkey") % 2 == 0, "ﬁＡ\U0001d401①²").otherwise("plain").alias("text"),
        font.alias("font"), (q == 50).alias("math"))
    return layout.code_lines(words).select("doc_id", "text", "family", "code")


@query("""
WITH o AS (SELECT o_orderkey AS id, o_custkey AS c, year(o_orderdate)::INT AS y, o_orderpriority AS s, lower(o_orderstatus) AS b FROM orders),
l AS (SELECT l_orderkey AS id, list({'key': chr(64 + l_linenumber::INT), 'text': l_returnflag} ORDER BY l_linenumber, l_partkey) AS options, list(chr(64 + l_linenumber::INT) ORDER BY l_linenumber, l_partkey) FILTER (l_linestatus = 'O') AS correct,
  list('img/' || l_partkey ORDER BY l_linenumber, 'img/' || l_partkey) FILTER (l_linenumber > 5) AS images
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2) GROUP BY 1),
q AS (SELECT o.*, {'id': o.id, 'slug': 'q-' || o.id, 'text': 'Order ' || o.id, 'options': coalesce(options, []), 'correct': coalesce(correct, []), 'images': coalesce(images, [])} AS question FROM o LEFT JOIN l USING (id)),
b AS (SELECT c, list({'slug': b, 'count': n} ORDER BY b) AS v FROM (SELECT c, b, count(*) AS n FROM o GROUP BY 1, 2) GROUP BY 1), t AS (SELECT c, list({'slug': s, 'count': n} ORDER BY s) AS v FROM (SELECT c, s, count(*) AS n FROM o GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT c, count(*)::INT AS n, list({'year': y, 'set': s, 'subject': b, 'question': question} ORDER BY -y, s, id) AS v FROM q GROUP BY 1)
SELECT 'exam-' || c_custkey AS slug, sha256(CASE WHEN p.n IS NULL THEN to_json({'slug': 'exam-' || c_custkey, 'name': c_name, 'question_count': 0, 'subjects': [], 'sets': [], 'questions': []})
  ELSE to_json({'slug': 'exam-' || c_custkey, 'name': c_name, 'question_count': p.n, 'subjects': b.v, 'sets': t.v, 'questions': p.v}) END::VARCHAR) AS document
FROM customer LEFT JOIN p ON p.c = c_custkey LEFT JOIN b ON b.c = c_custkey LEFT JOIN t ON t.c = c_custkey
""")
def exam_pages(spark, sf_dir):
    """Customers as exams by slug, each with its orders as questions: options, right keys and images in order, counts by subject and set. The page's digest."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_returnflag", "l_linestatus")])
    key, option = F.col("l_orderkey").alias("question_id"), F.concat_ws("-", "l_orderkey", "l_linenumber")
    image = F.concat(F.lit("img/"), F.col("l_partkey").cast("string"))
    orders = table(spark, sf_dir, "orders")
    questions = orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("q-"), "o_orderkey").alias("slug"), F.concat(F.lit("Order "), "o_orderkey").alias("text"))
    found = catalog.question_documents(
        questions, items.select(option.alias("id"), key, F.col("l_linenumber").alias("sequence"), F.char(64 + F.col("l_linenumber")).alias("option_key"), F.col("l_returnflag").alias("option_text")),
        items.where("l_linestatus = 'O'").select(key, option.alias("correct_option_id")), items.where("l_linenumber > 5").select(key, F.col("l_linenumber").alias("position"), image.alias("storage_key")))
    slug = F.concat(F.lit("exam-"), F.col("o_custkey").cast("string")).alias("slug")
    occurrences = orders.select(slug, F.col("o_orderkey").alias("question_id"), F.col("o_orderpriority").alias("question_set"), F.lower("o_orderstatus").alias("subject"), F.year("o_orderdate").alias("year"))
    exams = table(spark, sf_dir, "customer").select(F.concat(F.lit("exam-"), F.col("c_custkey").cast("string")).alias("slug"), F.col("c_name").alias("name"))
    return catalog.browse_documents(exams, occurrences, found).select("slug", F.sha2("document", 256).alias("document"))


@query("""
WITH s AS (SELECT s_name AS name, s_nationkey AS rate, s_suppkey % 2 = 0 AS enabled FROM supplier WHERE s_suppkey % 3 <> 0), d AS (SELECT s_name AS name, s_nationkey + 1 AS rate, s_suppkey % 5 = 0 AS out FROM supplier)
SELECT name, coalesce(d.rate, s.rate) AS rate, CASE WHEN out THEN false WHEN s.name IS NULL THEN true ELSE enabled END AS enabled FROM s FULL OUTER JOIN d USING (name)
""")
def defined_sources(spark, sf_dir):
    """Suppliers written as definition files, one for each nation, read back and merged into the sources that are stored."""
    rows = table(spark, sf_dir, "supplier")
    entry = F.concat(
        F.lit("  - name: \""), "s_name", F.lit("\"  # of a nation\n    limits: {rate: "), (F.col("s_nationkey") + 1).cast("string"), F.lit(", burst: [1, 2]}\n    rate: "), (F.col("s_nationkey") + 1).cast("string"),
        F.when(F.col("s_suppkey") % 5 == 0, "\n    onboarding: 'not_onboarded'").otherwise("\n    onboarding:"), F.lit("\n    note: >\n      folded\n      text"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", entry.alias("e")))), lambda x: x["e"]), "\n")
    path = new_path(spark, "definitions")
    rows.groupBy("s_nationkey").agg(F.concat(F.lit("sources:\n"), listed).alias("value")).repartition("s_nationkey").write.partitionBy("s_nationkey").text(path)
    given = definitions.definitions(definitions.definition_files(spark, path, "part-*"), "name string, rate bigint, onboarding string")
    stored = rows.where("s_suppkey % 3 <> 0").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("rate"), (F.col("s_suppkey") % 2 == 0).alias("enabled"))
    return lifecycle.sync_sources(stored, given)


@query("""
WITH o AS (SELECT o_orderkey, lower(o_orderpriority) AS slug, o_custkey AS lo, o_custkey + o_orderkey % 3 AS hi FROM orders)
SELECT o_orderkey, array_to_string(list_transform(string_split(replace(replace(slug, '-', ' '), '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name,
  CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || ' to ' || hi END AS answer FROM o
""")
def readable_labels(spark, sf_dir):
    """Names for slugs that nobody has named, and numerical answers as they are shown: a value or a range."""
    lo = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text.humanize(F.lower("o_orderpriority")).alias("name"), answers.range_label(lo, lo + F.col("o_orderkey") % 3).alias("answer"))
