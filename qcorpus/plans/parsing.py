"""Reading documents, pages and Markdown that are made of the driver's rows, and publishing decisions over them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import answers, richtext
from ..functions import text as tx
from ..operators import layout, lifecycle, practice, publish, review
from ..sources import markdown, pages, sites
from .documents import hash_sql, norm_sql
from .registry import query, table


def _boxes(rows, cells):
    """Word boxes (doc_id, page, text, x0, x1, top, bottom) of rows, from (text, x0, top) columns; a letter is five points wide."""
    words = F.explode(F.array(*[F.struct(t.alias("text"), F.lit(float(x)).alias("x0"), top.cast("double").alias("top")) for t, x, top in cells]))
    words = rows.select("doc_id", "page", words.alias("w")).select("doc_id", "page", "w.*").where("text is not null")
    return words.withColumn("x1", F.col("x0") + 5.0 * F.length("text")).withColumn("bottom", F.col("top") + 8.0)


@query("""
SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS number, l_linestatus AS qtype,
  (l_partkey || CASE WHEN l_linestatus = 'F' THEN ' to ' || l_suppkey ELSE '' END) AS key, NULL AS error
FROM (SELECT l_orderkey, l_linenumber, min(l_linestatus) AS l_linestatus, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2) i
WHERE EXISTS (SELECT 1 FROM lineitem f WHERE f.l_orderkey = i.l_orderkey AND f.l_linenumber = 1)
UNION ALL SELECT l_orderkey, NULL, NULL, NULL, 'no header' FROM lineitem GROUP BY 1 HAVING min(l_linenumber) > 1
""")
def key_table_rows(spark, sf_dir):
    """Orders as answer-key tables over two pages; line 1 brings a header in two lines, so orders without it have none."""
    columns = ("l_linestatus", "l_partkey", "l_suppkey")
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in columns])
    items = items.select("*", F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") > 3).cast("int").alias("page"))
    top = F.col("l_linenumber") * 20 + 100
    head = items.where("l_linenumber = 1")
    spell = lambda t, x, y: (F.lit(t), x, F.lit(y))
    words = _boxes(head, [spell("Q.", 0, 0), spell("No.", 15, 0), spell("Question", 100, 0), spell("Type", 105, 10), spell("Key", 200, 0), spell("Range", 198, 10)])
    nat = F.col("l_linestatus") == "F"
    width = 40.0  # a key may be eight digits wide; the words of a range stand less than a cell gap apart
    cells = [(F.col("l_linenumber").cast("string"), 5, top), (F.col("l_linestatus"), 110, top)]
    words = words.unionByName(_boxes(items, cells))
    key = _boxes(items, [(F.rpad(F.col("l_partkey").cast("string"), 8, "."), 200, top), (F.when(nat, F.lit("to")), 205 + width, top), (F.when(nat, F.col("l_suppkey").cast("string")), 220 + width, top)])
    words = words.unionByName(key.withColumn("text", F.regexp_replace("text", r"\.+$", "")))
    profile = {"number": ("Q. No.",), "qtype": ("Question Type", "Q. Type"), "key": ("Key/Range",)}
    found = layout.key_table(layout.line_words(words), profile)
    value = lambda c: F.try_element_at("values", F.lit(c)).alias(c)
    return found.select("doc_id", "number", value("qtype"), value("key"), "error")


@query("""
SELECT o_orderkey AS doc_id, 1 AS label, 'Q1 Pick of (A) and' || chr(10) || lower(o_orderstatus) AS stem,
  'A:' || o_custkey || ',B:' || o_orderpriority || ' more (C) not' AS options FROM orders
""")
def options_side_by_side(spark, sf_dir):
    """Orders as questions whose two options stand side by side; a marker in running text is none."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("page"), "o_orderstatus", "o_custkey", "o_orderpriority")
    w = lambda t, x, top: (F.lit(t) if isinstance(t, str) else t, x, F.lit(top))
    words = _boxes(rows, [
        w("Q1", 0, 0), w("Pick", 15, 0), w("of", 40, 0), w("(A)", 55, 0), w("and", 75, 0), w(F.lower("o_orderstatus"), 0, 20),
        w(F.concat(F.lit("(A)"), F.col("o_custkey").cast("string")), 0, 40), w("(B)", 200, 40), w(F.col("o_orderpriority"), 218, 40), w("more", 0, 60), w("(C)", 25, 60), w("not", 45, 60),
    ])
    lines = layout.line_words(words)
    labels = layout.segment(layout.group_lines(words), label=r"^Q(\d+)\b").select("doc_id", "page", "line", "label")
    found = layout.split_options(lines.join(labels, ["doc_id", "page", "line"]))
    told = F.array_join(F.transform("options", lambda o: F.concat(o["key"], F.lit(":"), o["text"])), ",")
    return found.select("doc_id", "label", "stem", told.alias("options"))


@query("""
WITH l AS (SELECT o_custkey AS doc, o_orderkey AS page, 'Page #' AS k, 0 AS body FROM orders UNION ALL SELECT o_custkey, o_orderkey, o_orderstatus, 0 FROM orders UNION ALL SELECT o_custkey, o_orderkey, NULL, 1 FROM orders),
p AS (SELECT doc, count(DISTINCT page) AS pages FROM l GROUP BY 1), s AS (SELECT doc, k, count(DISTINCT page) AS n FROM l WHERE body = 0 GROUP BY 1, 2),
r AS (SELECT s.doc, k FROM s JOIN p USING (doc) WHERE n >= greatest(2, round(pages * 0.6)))
SELECT doc AS doc_id, count(*) AS lines FROM l WHERE body = 1 OR NOT EXISTS (SELECT 1 FROM r WHERE r.doc = l.doc AND r.k = l.k) GROUP BY 1
""")
def running_lines(spark, sf_dir):
    """Customers as documents with a page for each order: numbered heads go, and feet that most pages share."""
    orders = table(spark, sf_dir, "orders")
    line = lambda n, top, text: F.struct(F.lit(n).alias("line"), F.lit(top).alias("top"), F.lit(top + 10).alias("bottom"), text.alias("text"))
    body = F.concat(F.lit("Body of page "), F.col("o_orderkey").cast("string"))
    rows = F.array(line(0, 5.0, F.concat(F.lit("Page "), F.col("o_orderkey").cast("string"))), line(1, 300.0, body), line(2, 785.0, F.col("o_orderstatus")))
    lines = orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page"), F.inline(rows))
    return layout.strip_running_text(lines, 800.0).groupBy("doc_id").agg(F.count("*").alias("lines"))


@query("""
WITH g AS (SELECT l_orderkey % 500 AS doc, l_orderkey AS page, l_linenumber AS x FROM lineitem), p AS (SELECT doc, count(DISTINCT page) AS pages FROM g GROUP BY 1),
s AS (SELECT doc, x, count(DISTINCT page) AS n FROM g GROUP BY 1, 2)
SELECT doc AS doc_id, count(*) AS graphics FROM g JOIN s USING (doc, x) JOIN p USING (doc) WHERE n < greatest(2, round(pages * 0.6)) GROUP BY 1
""")
def running_graphics(spark, sf_dir):
    """Graphics that do not stand at the same place on most pages of a document."""
    x = F.col("l_linenumber").cast("double")
    boxes = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("doc_id"), F.col("l_orderkey").alias("page"), (x + 0.2).alias("x0"), x.alias("top"), (x + 30).alias("x1"), (x + 40).alias("bottom"))
    return layout.strip_running_graphics(boxes, boxes.select("doc_id", "page")).groupBy("doc_id").agg(F.count("*").alias("graphics"))


@query("""
WITH l AS (SELECT l_orderkey AS doc, l_returnflag AS label, l_linenumber AS n, l_quantity < 10 AS lone, l_linenumber * 10 + CASE WHEN l_linenumber > 4 THEN 50 ELSE 0 END AS top FROM (SELECT l_orderkey, l_returnflag, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2, 3)),
o AS (SELECT *, row_number() OVER w AS place, top - lag(top + 8) OVER w > 18 AS gap, lone AS y FROM (SELECT doc, label, n, lone, top FROM l) WINDOW w AS (PARTITION BY doc, label ORDER BY n)),
r AS (SELECT *, place - sum(lone::INT) OVER (PARTITION BY doc, label ORDER BY n) AS run FROM o),
a AS (SELECT doc, label, 'math_fragments' AS code, sum(c)::BIGINT AS n FROM (SELECT doc, label, run, count(*) AS c FROM r WHERE lone GROUP BY 1, 2, 3 HAVING count(*) >= 2) GROUP BY 1, 2),
b AS (SELECT doc, label, 'layout_gap' AS code, count(*) AS n FROM r WHERE gap GROUP BY 1, 2),
c AS (SELECT doc, label, 'math_brackets' AS code, count(*) AS n FROM r WHERE NOT lone AND n % 2 = 0 GROUP BY 1, 2)
SELECT doc AS doc_id, label, code, n FROM a UNION ALL FROM b UNION ALL FROM c
""")
def layout_issues(spark, sf_dir):
    """Lone tokens, vertical gaps and unbalanced brackets in the labelled lines of orders."""
    n = F.col("l_linenumber")
    top = (n * 10 + F.when(n > 4, 50).otherwise(0)).cast("double")
    text = F.when(F.col("l_quantity") < 10, "x2").when(n % 2 == 0, "the value of (a").otherwise("the value of (b)")
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"))
    lines = items.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.col("l_returnflag").alias("label"), n.alias("line"), text.alias("text"), top.alias("top"), (top + 8).alias("bottom"))
    return review.detect_issues(lines, 18.0, 2)


_LEAD = """
WITH g AS (SELECT l_orderkey AS doc, l_linenumber AS n, min(l_quantity)::INT AS q FROM lineitem GROUP BY 1, 2), l AS (SELECT doc, n, n * 10 AS top, n * 10 + 6 + q % 8 AS bottom, n % 3 = 0 AS own FROM g),
x AS (SELECT a.*, (SELECT max(b.n) FROM l b WHERE b.doc = a.doc AND b.own AND b.n <= a.n) AS above, (SELECT min(b.n) FROM l b WHERE b.doc = a.doc AND b.own AND b.n > a.n) AS below FROM l a)
SELECT doc AS doc_id, n AS line, (CASE WHEN own OR below IS NULL OR EXISTS (SELECT 1 FROM l c WHERE c.doc = x.doc AND c.n >= x.n AND c.n < below AND c.bottom <= below * 10 - {0}) THEN above ELSE below END)::INT AS label FROM x
"""


def _leading(spark, sf_dir, tolerance):
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("int").alias("q"))
    n = F.col("l_linenumber")
    lines = items.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), n.alias("line"), F.when(n % 3 == 0, F.concat(F.lit("Q"), n.cast("string"), F.lit(". text"))).otherwise("text").alias("text"),
        F.lit(10.0).alias("x0"), (n * 10).cast("double").alias("top"), (n * 10 + 6 + F.col("q") % 8).cast("double").alias("bottom"))
    return layout.segment(lines, label=r"^Q(\d+)\b", lead_tolerance=tolerance).select("doc_id", "line", "label")


@query(_LEAD.format(0))
def lead_lines(spark, sf_dir):
    """Lines of orders dealt to labels; those that overlap the next label lead into it."""
    return _leading(spark, sf_dir, 0.0)


@query(_LEAD.format(4))
def lead_lines_tolerant(spark, sf_dir):
    """The same, with lines that end up to four points above the next label."""
    return _leading(spark, sf_dir, 4.0)


@query("""
WITH g AS (SELECT l_orderkey AS doc, l_linenumber AS n, min(l_quantity)::INT AS q FROM lineitem GROUP BY 1, 2),
l AS (SELECT doc, n, q, (1 + n // 4)::INT AS label, (n * 10 - CASE WHEN q % 7 = 0 THEN 6 ELSE 0 END)::DOUBLE AS top, q % 5 AS kind FROM g),
r AS (SELECT doc, label, min(top) AS low, max(top) + CASE WHEN min(q) % 4 = 0 THEN 200 ELSE 8 END AS high, sum(CASE kind WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 1 END) AS words FROM l GROUP BY 1, 2),
d AS (SELECT doc, top AS t, top + 2 AS b FROM l WHERE q % 11 = 1),
u AS (SELECT *, lag(top) OVER (PARTITION BY doc, label ORDER BY n) AS before FROM l WHERE kind <> 2),
s AS (SELECT *, n - sum((kind IN (0, 4))::INT) OVER (PARTITION BY doc, label ORDER BY n) - (n - row_number() OVER (PARTITION BY doc, label ORDER BY n)) AS run FROM l),
f AS (SELECT r.doc, r.label, 'figure' AS code, 'something is drawn in the question' AS detail FROM r JOIN d ON d.doc = r.doc AND d.b > low AND d.t < high
UNION SELECT doc, label, 'figure', 'a tall block with almost no words' FROM r WHERE words < 5 AND high - low > 120
UNION SELECT doc, label, 'image_option', 'an option has no text' FROM l WHERE q % 13 = 0
UNION SELECT doc, label, 'math', 'math or private-use glyphs' FROM l WHERE kind = 4
UNION SELECT doc, label, 'math', 'a row of sub- or superscripts' FROM u WHERE top - before > 0 AND top - before < 9
UNION SELECT doc, label, 'math', 'an inline sub- or superscript' FROM l WHERE kind = 3
UNION SELECT doc, label, 'math', 'single tokens stacked on 3+ lines' FROM s WHERE kind IN (0, 4) GROUP BY doc, label, run HAVING count(*) >= 3
UNION SELECT doc, label, 'layout', 'wide gaps inside a line' FROM l WHERE kind = 1 AND q >= 40)
SELECT doc AS doc_id, label, code, detail FROM f
""")
def question_layout_issues(spark, sf_dir):
    """All layout trouble of questions whose lines are those of orders: figures, options that are images, mathematics, wide gaps."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line")).agg(F.min("l_quantity").cast("int").alias("q"))
    n, q = F.col("line"), F.col("q")
    top = (n * 10 - F.when(q % 7 == 0, 6).otherwise(0)).cast("double")
    lines = items.select("doc_id", "line", "q", (1 + F.floor(n / 4)).cast("int").alias("label"), F.lit(0).alias("page"), top.alias("top"))
    word = lambda text, x0, x1, size: F.struct(F.lit(text).alias("text"), F.lit(float(x0)).alias("x0"), (F.lit(x1) if isinstance(x1, (int, float)) else x1).cast("double").alias("x1"), F.lit(float(size)).alias("size"))
    far = F.struct(F.lit("beta").alias("text"), (35 + q).cast("double").alias("x0"), (60 + q).cast("double").alias("x1"), F.lit(10.0).alias("size"))
    said = (
        F.when(q % 5 == 0, F.array(word("x", 10, 15, 10))).when(q % 5 == 1, F.array(word("alpha", 10, 35, 10), far)).when(q % 5 == 2, F.array(word("(B)", 10, 20, 10), word("value", 25, 50, 10)))
        .when(q % 5 == 3, F.array(word("a", 10, 15, 10), word("b", 16, 18, 6), word("c", 20, 25, 10))).otherwise(F.array(word("\U0001d465y", 10, 20, 10))))
    words = lines.select("doc_id", "label", "page", "line", "top", F.lit(True).alias("stem"), F.inline(said))
    height = F.when(F.min("q") % 4 == 0, 200).otherwise(8)
    regions = lines.groupBy("doc_id", "label").agg(F.min("top").alias("top"), (F.max("top") + height).cast("double").alias("bottom")).select(
        "*", F.lit(0).alias("page"), F.lit(0).alias("region"), F.lit(0.0).alias("x0"), F.lit(200.0).alias("x1"))
    kind = F.when(q % 11 == 1, "line").when(q % 11 == 0, "rect")
    graphics = lines.select("doc_id", "page", kind.alias("kind"), F.lit(100.0).alias("x0"), F.when(q % 11 == 1, 150.0).otherwise(101.0).alias("x1"), "top", (F.col("top") + 2).alias("bottom")).where("kind is not null")
    options = lines.select("doc_id", "label", F.when(q % 13 == 0, "").otherwise("v").alias("text"))
    return review.question_issues(words, options, regions, graphics)


@query("""
SELECT 'https://p.org/' || p_partkey AS url, 1 AS number, p_name AS question_text, 'A:' || p_brand || ',B:' || p_type || ' & more' AS options,
  CASE WHEN p_size % 3 = 0 THEN 'B' ELSE '' END AS correct, CASE WHEN p_size % 2 = 0 THEN 'As seen' END AS explanation, CASE WHEN p_size % 3 <> 0 THEN 'no correct option' END AS error
FROM part
""")
def quiz_questions(spark, sf_dir):
    """Parts as pages with a quiz: one question with two options, of which one may be marked as right."""
    mark = F.when(F.col("p_size") % 3 == 0, ' class="choice is-correct"').otherwise("")
    why = F.when(F.col("p_size") % 2 == 0, '<div class="rationale">As <i>seen</i></div>').otherwise("")
    html = F.concat(
        F.lit("<html><body><form><fieldset><legend>"), "p_name", F.lit("</legend><label>"), "p_brand", F.lit("</label><label"), mark, F.lit("><input>"), "p_type",
        F.lit(" &amp; more</label><label>"), "p_brand", F.lit("</label>"), why, F.lit("</fieldset></form></body></html>"))
    found = pages.parse_quizzes(table(spark, sf_dir, "part").select(F.concat(F.lit("https://p.org/"), F.col("p_partkey").cast("string")).alias("url"), html.alias("html")))
    told = F.array_join(F.transform("options", lambda o: F.concat(o["key"], F.lit(":"), o["text"])), ",")
    return found.select("url", "number", "question_text", told.alias("options"), F.array_join("correct_keys", ",").alias("correct"), "explanation", "error")


@query("""
SELECT 'c' || c_custkey || '.md' AS path, 'seg ' || c_mktsegment AS exam, n AS number, c_name || chr(10) || '```' || chr(10) || '- A. no option' || chr(10) || '```' AS question_text,
  CASE n WHEN 1 THEN 'A:one,B:two words' ELSE '' END AS options, CASE n WHEN 1 THEN 'B' ELSE c_nationkey::VARCHAR END AS answer,
  CASE n WHEN 1 THEN 'because' || chr(10) || 'of it' END AS explanation, NULL AS error
FROM customer, (VALUES (1), (2)) t(n) WHERE c_custkey % 5 <> 0
UNION ALL SELECT 'c' || c_custkey || '.md', NULL, NULL, NULL, NULL, NULL, NULL, 'no front matter' FROM customer WHERE c_custkey % 5 = 0
""")
def markdown_questions(spark, sf_dir):
    """Customers as Markdown files of two questions; every fifth lacks its front matter."""
    head = F.concat(F.lit('---\nexam: "seg '), "c_mktsegment", F.lit('"\n---\n'))
    body = F.concat(F.lit("# Question {}\n"), "c_name", F.lit("\n```\n- A. no option\n```\n"))
    first = F.concat(F.replace(body, F.lit("{}"), F.lit("1")), F.lit("- A. one\n- B. two words\n\n**Answer:** B\n**Explanation:** because\nof it\n\n"))
    second = F.concat(F.replace(body, F.lit("{}"), F.lit("2")), F.lit("\n**Answer:** "), F.col("c_nationkey").cast("string"), F.lit("\n"))
    content = F.concat(F.when(F.col("c_custkey") % 5 == 0, "").otherwise(head), first, second)
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".md")).alias("path"), content.alias("content"))
    found = markdown.parse_markdown(files)
    told = F.array_join(F.transform("options", lambda o: F.concat(o["key"], F.lit(":"), o["text"])), ",")
    return found.select("path", F.try_element_at("front_matter", F.lit("exam")).alias("exam"), "number", "question_text", told.alias("options"), "answer", "explanation", "error")


@query("""
SELECT page_id FROM pages WHERE page_id % 3 = 1 AND TIMESTAMP '2024-01-01' + to_days((page_id % 100)::INT) >= TIMESTAMP '2024-02-10'
""")
def replayed_artifacts(spark, sf_dir):
    """Stored pages of a source to parse again, from a day on."""
    day = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("page_id") % 100).cast("int"))
    stored = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("s"), (F.col("page_id") % 3).cast("string")).alias("source"), day.alias("fetched_at"))
    return pages.replay(stored, "s1", "2024-02-10 00:00:00").select("page_id")


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Paper ' || p_brand || ' has been retired this spring! Now ' || p_brand || ' is replaced by ' || p_type || '.'
  WHEN 1 THEN 'Such papers are retired.' END AS notice FROM part
""")
def retirement_notices(spark, sf_dir):
    """What warning boxes of pages say of papers that have ended, not of those that will end."""
    kind, brand = F.col("p_size") % 4, F.col("p_brand")
    told = F.concat(F.lit("Fees rise. Paper "), brand, F.lit(" has been <i>retired</i> this spring! Ask your school. Now "), brand, F.lit(" is replaced by "), F.col("p_type"), F.lit("."))
    said = F.when(kind == 0, told).when(kind == 1, F.lit("Such papers are retired.")).when(kind == 2, F.lit("This paper is about to be retired."))
    box = F.concat(F.lit("<p>Older ones were retired.</p><div id='b' class='wide Warning'><b>Warning</b> "), said, F.lit("</div><div>All else was retired.</div>"))
    return table(spark, sf_dir, "part").select("p_partkey", pages.retirement_notice(F.coalesce(box, F.lit("<p>It was retired.</p>"))).alias("notice"))


@query("""
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name || chr(10) || chr(10) || 'end' WHEN 1 THEN NULL ELSE c_name END AS explanation,
  CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '' ELSE c_mktsegment END AS rationale,
  CASE WHEN c_nationkey % 4 = 0 THEN '' WHEN c_nationkey % 4 = 1 THEN 'A' WHEN c_nationkey % 4 = 2 THEN 'A and B' ELSE 'A, B and ' || c_mktsegment END AS keys,
  CASE WHEN c_custkey % 2 = 0 THEN 'https://x.org/' || c_custkey END AS link
FROM customer
""")
def explanation_texts(spark, sf_dir):
    """Explanations without what crawlers add, their labelled sections, lists of keys and further reading."""
    kind, name = F.col("c_custkey") % 3, F.col("c_name")
    crawl = F.lit("\n  copied by the crawler, today\n")
    raw = F.when(kind == 0, F.concat(name, F.lit("  "), crawl, F.lit("\n\n\nend"))).when(kind == 1, F.concat(F.lit("Rationale:"), crawl)).otherwise(name)
    labelled = F.when(kind == 2, F.concat(F.lit("Answer: A Rationale: "), "c_mktsegment", F.lit(" Source: x"))).otherwise(name)
    keys = F.slice(F.array(F.lit("A"), F.lit("B"), F.col("c_mktsegment")), 1, (F.col("c_nationkey") % 4).cast("int"))
    url = F.concat(F.lit("https://x.org/"), F.col("c_custkey").cast("string"))
    links = F.array(F.struct(F.lit("Doc").alias("text"), F.when(F.col("c_custkey") % 2 == 0, url).otherwise("javascript:x").alias("url")))
    read = F.regexp_extract(richtext.with_reading_links(name, links), r"\(([^)]*)\)", 1)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", tx.strip_boilerplate(raw, ("Copied by the crawler",)).alias("explanation"), tx.labelled_section(labelled, "Rationale", ("Source",)).alias("rationale"),
        tx.key_list(keys).alias("keys"), F.nullif(read, F.lit("")).alias("link"))


@query("""
SELECT s_suppkey, s_suppkey % 4 < 2 AS menu, CASE WHEN s_suppkey % 3 = 0 THEN 'image/png' END AS mime, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS content FROM supplier
""")
def menu_links_and_data_uris(spark, sf_dir):
    """Links that lead to a site's menu, and images given as data URIs."""
    n = F.col("s_suppkey")
    path = F.when(n % 4 == 0, "en-us/").when(n % 4 == 1, "en-us/training").otherwise(F.concat(F.lit("en-us/training/"), n.cast("string")))
    uri = F.when(n % 3 == 0, F.concat(F.lit("data:image/png;base64,"), F.base64(F.col("s_name").cast("binary")))).otherwise("https://x.org/a.png")
    image = richtext.data_uri(uri)
    menu = richtext.is_menu_link(F.concat(F.lit("https://learn.x.org/"), path), "x.org", ("training",))
    return table(spark, sf_dir, "supplier").select("s_suppkey", menu.alias("menu"), image["mime"].alias("mime"), image["content"].cast("string").alias("content"))


@query("""
WITH i AS (SELECT o_orderkey AS id, 'P' || o_custkey AS stable, o_orderkey % 7 = 0 AS force, CASE WHEN o_orderkey % 11 = 0 THEN o_custkey END AS existing FROM orders WHERE o_orderstatus <> 'F' OR o_custkey % 3 <> 0),
s AS (SELECT DISTINCT o_custkey AS id, 'P' || o_custkey AS stable FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 = 0),
d AS (SELECT i.*, s.id AS taken FROM i LEFT JOIN s USING (stable)),
a AS (SELECT *, CASE WHEN NOT force AND existing IS NOT NULL THEN 'linked' WHEN taken IS NOT NULL AND NOT force THEN 'held' ELSE 'created' END AS act,
  CASE WHEN force AND taken IS NOT NULL THEN stable || '-D' || id % 2 ELSE stable END AS own FROM d),
r AS (SELECT *, act = 'created' AND row_number() OVER (PARTITION BY own, act ORDER BY id) > 1 AS later FROM a)
SELECT id, CASE WHEN later THEN 'held' ELSE act END AS action, CASE WHEN act = 'linked' THEN existing WHEN act = 'held' THEN taken END AS question, own AS stable_id FROM r
""")
def resolved_positions(spark, sf_dir):
    """Orders as questions for positions named by the customer, some of which the filled orders of every third customer have."""
    orders = table(spark, sf_dir, "orders")
    stable = F.concat(F.lit("P"), F.col("o_custkey").cast("string"))
    stored = orders.where("o_orderstatus = 'F' and o_custkey % 3 = 0").select(F.col("o_custkey").alias("id"), stable.alias("stable_id")).distinct()
    n = F.col("o_orderkey")
    incoming = orders.where("o_orderstatus <> 'F' or o_custkey % 3 <> 0").select(
        n.alias("id"), stable.alias("stable_id"), F.concat(stable, F.lit("-D"), (n % 2).cast("string")).alias("distinct_id"),
        F.when(n % 11 == 0, F.col("o_custkey")).alias("existing"), (n % 7 == 0).alias("force_new"))
    return publish.resolve_questions(incoming, stored, ["id"], hold_if_taken=True)


@query(f"""
WITH q AS (SELECT o_orderkey AS id, o_orderkey % 4 AS k FROM orders), n AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1),
g AS (SELECT q.id FROM q LEFT JOIN n USING (id) WHERE k = 1 AND coalesce(n, 0) = 2),
o AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS q, l_linestatus AS k, l_returnflag AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_orderkey * 10 + l_linenumber) AS place FROM lineitem)
SELECT 'question' AS part, id, CASE WHEN id IN (FROM g) THEN 'new wording' ELSE 'Old *text*' END AS one, CASE WHEN id IN (FROM g) THEN 'markdown' ELSE 'plain' END AS two,
  CASE WHEN id IN (FROM g) THEN 'a\\*b' ELSE 'a*b' END AS three FROM q
UNION ALL SELECT 'option', id, CASE WHEN q IN (FROM g) THEN CASE place WHEN 1 THEN 'A' ELSE 'B' END ELSE k END, CASE WHEN q IN (FROM g) THEN CASE place WHEN 1 THEN 'x' ELSE 'y' END ELSE t END, NULL FROM o
UNION ALL SELECT 'variant', id, {hash_sql(norm_sql("'Old *text*'"))}, 'Old *text*', NULL FROM g
UNION ALL SELECT 'error', id, 'another number of options', NULL, NULL FROM q WHERE k = 1 AND id NOT IN (FROM g)
""")
def reworded_questions(spark, sf_dir):
    """Orders as published questions, their lines as options; every fourth gets a new version with two options. All four tables."""
    questions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("Old *text*").alias("question_text"), F.lit("plain").alias("text_format"), F.lit("a*b").alias("explanation"))
    options = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("position"), F.col("l_linestatus").alias("option_key"), F.col("l_returnflag").alias("option_text"))
    two = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(t).alias("text")) for k, t in (("A", "x"), ("B", "y"))])
    chosen = questions.where("id % 4 = 1").select("id", F.lit("new wording").alias("question_text"), F.lit("markdown").alias("text_format"), F.lit(None).cast("string").alias("explanation"), two.alias("options"))
    variants = spark.createDataFrame([], "question_id long, content_hash string, text string")
    changed, options, variants, errors = publish.reword_questions(questions, options, variants, chosen)
    none = F.lit(None).cast("string").alias("three")
    return (
        changed.select(F.lit("question").alias("part"), "id", F.col("question_text").alias("one"), F.col("text_format").alias("two"), F.col("explanation").alias("three"))
        .unionByName(options.select(F.lit("option").alias("part"), "id", F.col("option_key").alias("one"), F.col("option_text").alias("two"), none))
        .unionByName(variants.select(F.lit("variant").alias("part"), F.col("question_id").alias("id"), F.col("content_hash").alias("one"), F.col("text").alias("two"), none))
        .unionByName(errors.select(F.lit("error").alias("part"), "id", F.col("error").alias("one"), F.lit(None).cast("string").alias("two"), none)))


@query("""
WITH o AS (SELECT l_orderkey AS id, string_agg(DISTINCT lower(l_returnflag), ',' ORDER BY lower(l_returnflag)) AS options,
  string_agg(DISTINCT lower(l_returnflag), ',' ORDER BY lower(l_returnflag)) FILTER (l_linenumber % 2 = 1) AS right_ones FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, coalesce(options, '') AS options, concat_ws(',', CASE WHEN o_orderstatus = 'F' THEN (o_custkey::DOUBLE)::VARCHAR || '..' || ((o_custkey + 1)::DOUBLE)::VARCHAR END, right_ones) AS answers
FROM orders LEFT JOIN o ON id = o_orderkey
""")
def published_shapes(spark, sf_dir):
    """Options and answers of orders as published questions: odd lines are right, filled orders have a range too."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    option_id = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    options = items.select(option_id.alias("id"), F.col("l_orderkey").alias("question_id"), F.concat("l_returnflag", F.lit("!")).alias("option_text"))
    none = [F.lit(None).cast("string").alias("text_answer"), F.lit(None).cast("double").alias("numerical_answer")]
    by_option = items.where("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("question_id"), option_id.alias("correct_option_id"), *none, F.lit(None).cast("double").alias("numeric_min"), F.lit(None).cast("double").alias("numeric_max"))
    ranges = orders.where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("question_id"), F.lit(None).cast("long").alias("correct_option_id"), *none, F.col("o_custkey").cast("double").alias("numeric_min"), (F.col("o_custkey") + 1).cast("double").alias("numeric_max"))
    found = answers.published_shape(orders.select(F.col("o_orderkey").alias("id")), options, by_option.unionByName(ranges))
    return found.select("id", F.array_join("options", ",").alias("options"), F.array_join("answers", ",").alias("answers"))


@query("""
WITH a AS (SELECT l_orderkey AS q, list_sort(list_distinct(list(l_linenumber::VARCHAR))) AS c FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1),
t AS (SELECT l_orderkey AS q, list_sort(list_distinct(list(l_linenumber::VARCHAR))) AS s FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1)
SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS user_id, CASE WHEN o_custkey % 2 = 1 THEN 's' || o_custkey END AS session_id, coalesce(s = c, false) AS is_correct
FROM orders JOIN a ON a.q = o_orderkey LEFT JOIN t ON t.q = o_orderkey
""")
def recorded_attempts(spark, sf_dir):
    """Orders as attempts on questions whose right options are the lines that were not returned."""
    items = table(spark, sf_dir, "lineitem").withColumn("option", F.col("l_linenumber").cast("string"))
    no = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    answers_ = items.where("l_returnflag <> 'A'").select(F.col("l_orderkey").alias("question_id"), F.col("option").alias("option_id"), *no("double", "numeric_min", "numeric_max"), *no("string", "text_answer"))
    chosen = items.where("l_linenumber <> 7").groupBy(F.col("l_orderkey").alias("question_id")).agg(F.collect_list("option").alias("selected"))
    user = F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("user_id")
    attempts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("question_id"), user, F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("session_id"), *no("string", "numeric_answer"))
    return practice.record_attempts(attempts.join(chosen, "question_id", "left"), answers_).select("id", "user_id", "session_id", "is_correct")


@query("""
WITH n AS (SELECT o_custkey AS id, count(*) AS c, count(*) FILTER (o_orderstatus = 'F') AS i FROM orders GROUP BY 1)
SELECT c_custkey AS id, c AS correct, i AS incorrect FROM customer LEFT JOIN n ON id = c_custkey
""")
def finished_sessions(spark, sf_dir):
    """Customers as practice sessions, of which those with orders have their results."""
    sessions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(None).cast("long").alias("correct"), F.lit(None).cast("long").alias("incorrect"))
    results = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("correct"), F.count_if(F.col("o_orderstatus") == "F").alias("incorrect"))
    return practice.finish_sessions(sessions, results)


@query("""
WITH r AS (SELECT o_orderpriority AS paper, count(*) AS questions, count(*) FILTER (o_orderstatus = 'F') AS ready FROM orders GROUP BY 1)
SELECT paper || '.json' AS path, '{"questions":' || questions || ',"ready":' || ready || '}' AS body FROM r
UNION ALL SELECT 'README.md', '| [' || paper || '](' || paper || '.json) | ' || questions || ' | ' || ready || ' |' FROM r
UNION ALL SELECT 'README.md', '| **All** | **' || sum(questions) || '** | **' || sum(ready) || '** |' FROM r
""")
def count_reports(spark, sf_dir):
    """Counts of each paper as JSON, and the lines of a Markdown table with their total."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("paper")).agg(F.count("*").alias("questions"), F.count_if(F.col("o_orderstatus") == "F").alias("ready"))
    files, lines = review.count_reports(counts, "paper", ["questions", "ready"])
    return files.select("path", F.col("json").alias("body")).unionByName(lines.select(F.lit("README.md").alias("path"), F.col("line").alias("body")))


@query("""
WITH d AS (SELECT c_custkey, c_mktsegment AS org, c_nationkey % 5 AS kind, c_name AS exam FROM customer), known AS (SELECT DISTINCT org FROM d WHERE c_custkey % 2 = 0),
o AS (SELECT d.*, CASE WHEN org IN (FROM known) THEN 'old-' || org ELSE sha256(chr(0) || chr(31) || org) END AS org_id FROM d),
k AS (SELECT *, sha256(org_id || chr(31) || kind) AS kind_id FROM o)
SELECT c_custkey, org_id, kind_id, sha256(kind_id || chr(31) || exam) AS id FROM k
""")
def registered_chain(spark, sf_dir):
    """Organisations, types and exams that customers name, found or created one below the other: each customer's whole chain."""
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey"), F.col("c_mktsegment").alias("org"), (F.col("c_nationkey") % 5).alias("kind"), F.col("c_name").alias("exam"))
    known = wanted.where("c_custkey % 2 = 0").select(F.lit(None).cast("string").alias("parent_id"), "org", F.concat(F.lit("old-"), "org").alias("id")).distinct()
    none = lambda key, kind: spark.createDataFrame([], f"parent_id string, {key} {kind}, id string")
    tables, rows = publish.register_chain([(known, ["org"]), (none("kind", "long"), ["kind"]), (none("exam", "string"), ["exam"])], wanted)
    above = lambda t, name: t.select(F.col("id").alias(name), F.col("parent_id").alias(f"{name}_parent"))
    whole = rows.select("c_custkey", "id").join(above(tables[2], "_exam"), F.col("id") == F.col("_exam")).join(above(tables[1], "kind_id"), F.col("_exam_parent") == F.col("kind_id"))
    return whole.select("c_custkey", F.col("kind_id_parent").alias("org_id"), "kind_id", "id")


@query("""
SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'mcq' WHEN 1 THEN 'multiple_correct' WHEN 2 THEN 'mcq' ELSE 'text' END AS question_type,
  CASE WHEN c_custkey % 4 = 3 THEN '' ELSE 'A:' || c_name || ',B:' || c_mktsegment || ',C:x y' END AS options,
  CASE c_custkey % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'A,C' WHEN 2 THEN 'C' ELSE '' END AS correct, CASE WHEN c_custkey % 4 IN (0, 2) THEN round(c_nationkey / 3, 2) END AS negative_marks
FROM customer
""")
def normalized_questions(spark, sf_dir):
    """Customers as extracted questions, answered by letters or by the text of an option."""
    k = F.col("c_custkey") % 4
    texts = F.when(k < 3, F.array(F.concat(F.lit(" "), "c_name"), F.col("c_mktsegment"), F.lit("x y")))
    answer = F.when(k == 0, "b").when(k == 1, "C, a").when(k == 2, " X Y").otherwise("free text")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("question_text"), texts.alias("option_texts"), answer.alias("answer"), F.col("c_nationkey").cast("double").alias("marks"))
    told = F.array_join(F.transform("options", lambda o: F.concat(o["key"], F.lit(":"), o["text"])), ",")
    return publish.normalize_extracted(rows).select("id", "question_type", told.alias("options"), F.array_join("correct_keys", ",").alias("correct"), "negative_marks")


@query("""
WITH s AS (SELECT s_name AS name, s_nationkey AS rate, s_suppkey % 2 = 0 AS enabled FROM supplier WHERE s_suppkey % 3 <> 0), d AS (SELECT s_name AS name, s_nationkey + 1 AS rate, s_suppkey % 5 = 0 AS out FROM supplier WHERE s_suppkey % 4 <> 0 OR s_suppkey % 3 = 0)
SELECT name, coalesce(d.rate, s.rate) AS rate, CASE WHEN out THEN false WHEN s.name IS NULL THEN true ELSE enabled END AS enabled FROM s FULL OUTER JOIN d USING (name)
""")
def synced_sources(spark, sf_dir):
    """Suppliers as sources and their definitions, of which every fifth is not onboarded."""
    rows = table(spark, sf_dir, "supplier")
    stored = rows.where("s_suppkey % 3 <> 0").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("rate"), (F.col("s_suppkey") % 2 == 0).alias("enabled"))
    given = rows.where("s_suppkey % 4 <> 0 or s_suppkey % 3 = 0").select(F.col("s_name").alias("name"), (F.col("s_nationkey") + 1).alias("rate"), F.when(F.col("s_suppkey") % 5 == 0, "not_onboarded").alias("onboarding"))
    return lifecycle.sync_sources(stored, given)


@query("""
WITH o AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'in_review' WHEN 'O' THEN 'ready' ELSE 'held' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'b' || o_custkey END AS batch, o_custkey FROM orders)
SELECT id, CASE WHEN status = 'ready' AND batch IS NULL THEN 'in_review' ELSE status END AS status, CASE WHEN status = 'ready' AND batch IS NULL THEN 'new' ELSE batch END AS batch,
  sha256('{' || coalesce('"batch":"' || batch || '",', '') || '"id":' || id || ',"status":"' || status || '"}') AS hash FROM o
""")
def items_into_review(spark, sf_dir):
    """Orders as intake items: the ready ones that are in no batch go into a new one; each has the hash of its content before."""
    status = F.when(F.col("o_orderstatus") == "F", "in_review").when(F.col("o_orderstatus") == "O", "ready").otherwise("held")
    batch = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("b"), F.col("o_custkey").cast("string")))
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), batch.alias("batch"))
    items = items.withColumn("hash", lifecycle.canonical_hash("id", "status", "batch")).withColumnRenamed("batch", "review_batch_id")
    marked = lifecycle.mark_in_review(items, lifecycle.ready_for_batch(items, "id"), "new")
    return marked.withColumnRenamed("review_batch_id", "batch")


@query("""
SELECT 'https://e.org/' || page_id AS url, 'Page ' || page_id AS question_text, CASE WHEN page_id % 2 = 0 THEN 'B' ELSE '' END AS correct
FROM pages WHERE page_id % 3 = 1
""")
def replayed_quizzes(spark, sf_dir):
    """Stored artifacts of a source, parsed again as quizzes."""
    right = F.when(F.col("page_id") % 2 == 0, ' class="is-correct"').otherwise("")
    page = F.col("page_id").cast("string")
    html = F.concat(F.lit("<fieldset><legend>Page "), page, F.lit("</legend><label>x</label><label"), right, F.lit(">y</label></fieldset>"))
    stored = table(spark, sf_dir, "pages").select(F.concat(F.lit("https://e.org/"), page).alias("url"), html.alias("html"), F.concat(F.lit("s"), (F.col("page_id") % 3).cast("string")).alias("source"))
    return pages.replay(stored, "s1", parser=pages.parse_quizzes).select("url", "question_text", F.array_join("correct_keys", ",").alias("correct"))


@query("SELECT doc_id, text[1:200] AS excerpt FROM documents")
def document_excerpts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.excerpt(F.col("text")).alias("excerpt"))


@query("""
WITH j AS (SELECT 'k' || o_custkey AS key, min(o_orderkey) AS id FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), n AS (SELECT DISTINCT 'k' || o_custkey AS key FROM orders WHERE o_orderkey % 2 = 1)
SELECT key, id FROM j UNION ALL SELECT key, NULL FROM n WHERE key NOT IN (SELECT key FROM j)
""")
def created_jobs(spark, sf_dir):
    """Jobs are created once for a key: those of odd orders, where even ones have none for the customer."""
    from ..operators.merge import insert_absent

    orders = table(spark, sf_dir, "orders").withColumn("key", F.concat(F.lit("k"), F.col("o_custkey").cast("string")))
    jobs = orders.where("o_orderkey % 2 = 0").groupBy("key").agg(F.min("o_orderkey").alias("id"))
    return insert_absent(jobs, orders.where("o_orderkey % 2 = 1").select("key", F.lit(None).cast("long").alias("id")), ["key"])


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'low' WHEN o_orderpriority = '1-URGENT' THEN 'high' ELSE 'medium' END AS confidence
FROM orders WHERE year(o_orderdate) = 1995
""")
def paper_confidence(spark, sf_dir):
    """The catalog's papers of a year, with the confidence in each."""
    from ..operators.catalog import find_papers

    papers = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "official").otherwise("community")
    return find_papers(papers, year=1995).select("o_orderkey", publish.confidence(F.col("o_orderstatus") != "P", kind).alias("confidence"))


@query("""
SELECT 'https://q.blocks.org/' || s_suppkey AS url, 1 AS number, 'What is the name of ' || s_name || ' ?' AS question_text, 'A:' || s_nationkey || '|B:' || s_suppkey AS options, 'B' AS answer, 'as ' || s_name AS explanation
FROM supplier WHERE s_suppkey % 3 > 0
""")
def block_site_questions(spark, sf_dir):
    """Pages of question blocks, by host; a block with an empty option is left out, a repeated one counts once."""
    n = F.col("s_suppkey")
    option = F.when(n % 3 == 0, "").otherwise(n.cast("string"))
    block = F.concat(
        F.lit("<div class='bix-div-container'><div class='bix-td-qtxt'>What is the <i>name</i> of <b>"), "s_name", F.lit("</b>?</div><div class='bix-td-option-val'>"), F.col("s_nationkey").cast("string"),
        F.lit("</div><div class='bix-td-option-val'>"), option, F.lit("</div><input class='jq-hdnakq' value='B'><div class='bix-ans-description'>as "), "s_name", F.lit("</div></div>"))
    found = _site(spark, table(spark, sf_dir, "supplier").select(F.concat(F.lit("https://q.blocks.org/"), n.cast("string")).alias("url"), F.concat(block, block).alias("html")))
    return found.select("url", "number", "question_text", _told(), "answer", "explanation")


@query("""
SELECT 'https://cards.org/' || c_custkey AS url, 1 AS number, 'Which segment has ' || c_name || '?' AS question_text, 'A:A. ' || c_mktsegment || '|B:B. none' AS options,
  CASE c_custkey % 3 WHEN 0 THEN 'A. ' || c_mktsegment WHEN 1 THEN 'B. none' END AS answer, CASE WHEN c_custkey % 3 = 2 THEN 'no answer' END AS error FROM customer
""")
def card_site_questions(spark, sf_dir):
    """Pages of question cards, by host; without a letter there is no answer."""
    n = F.col("c_custkey")
    letter = F.when(n % 3 == 0, "A").when(n % 3 == 1, "B").otherwise("")
    card = F.concat(
        F.lit("<div class='exam-question-card'><div class='card-header'>Question #7</div><div class='question-body'><p class='card-text'>Introductory Info</p><p class='card-text'>Which segment has "), "c_name",
        F.lit("?</p><ul><li class='multi-choice-item'>A. "), "c_mktsegment", F.lit("</li><li class='multi-choice-item'>B. none</li></ul><span class='correct-answer'>"), letter, F.lit("</span></div></div>"))
    found = _site(spark, table(spark, sf_dir, "customer").select(F.concat(F.lit("https://cards.org/"), n.cast("string")).alias("url"), card.alias("html")))
    return found.select("url", "number", "question_text", _told(), "answer", "error")


@query("""
SELECT 'https://text.org/' || o_orderkey AS url, 1 AS number, o_orderkey || '. Who placed the order of ' || o_custkey || ' that day?' AS question_text,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Answer: ' || o_orderpriority END AS answer, 'fewer than two options' AS error FROM orders
UNION ALL SELECT 'https://else.org/' || o_orderkey, 1, 'Which status has order ' || o_orderkey || '?', NULL, CASE WHEN o_orderkey % 3 = 0 THEN 'fewer than two options' ELSE 'no answer' END FROM orders
""")
def text_site_questions(spark, sf_dir):
    """Pages of numbered paragraphs with folded answers, and pages of hosts without a parser of their own; no option is made up."""
    key = F.col("o_orderkey").cast("string")
    fold = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("<div class='collapse'>Answer: "), "o_orderpriority", F.lit("</div>"))).otherwise("")
    text = F.concat(F.lit("<div class='entry-content'><p>"), key, F.lit(". Who placed the order of "), F.col("o_custkey").cast("string"), F.lit(" that day?</p>"), fold, F.lit("</div><p>9. This is outside of the content.</p>"))
    other = F.concat(F.lit("<div class='quiz'><p>Which status has order "), key, F.lit("?</p><ul><li>a) F</li>"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("<li>b) O</li>"), F.lit("</ul></div>"))
    # dealt out while they are narrow: a file may be few splits, and its pages are much work
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    rows = orders.select(F.concat(F.lit("https://text.org/"), key).alias("url"), text.alias("html")).unionByName(orders.select(F.concat(F.lit("https://else.org/"), key).alias("url"), other.alias("html")))
    return _site(spark, rows).select("url", "number", "question_text", "answer", "error")


def _site(spark, rows):
    hosts = spark.sql("SELECT * FROM VALUES ('blocks.org', 'blocks'), ('cards.org', 'cards'), ('text.org', 'paragraphs') AS t(host, profile)")
    return sites.parse_sites(rows, hosts)


def _told():
    return F.array_join(F.transform("options", lambda o: F.concat(o["key"], F.lit(":"), o["text"])), "|").alias("options")


@query("""
WITH RECURSIVE p AS (SELECT s_suppkey AS k, s_nationkey AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier),
r(n, i) AS (SELECT n, i FROM p WHERE i = 1 UNION ALL SELECT p.n, p.i FROM r JOIN p ON p.n = r.n AND p.i = r.i + 1 WHERE p.k % 7 <> 0)
SELECT 'https://e.org/' || n || '/page/' || i AS url, (i - 1)::INT AS depth FROM r
""")
def paged_reach(spark, sf_dir):
    """Pages that next links lead to from each nation's first page of suppliers; a page whose supplier's key is divisible by seven is linked by no page before."""
    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", place.alias("i"))
    after = F.lead("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("i"))
    base = F.concat(F.lit("https://e.org/"), F.col("s_nationkey").cast("string"), F.lit("/page/"))
    url = lambda i: F.concat(base, i.cast("string"))
    rows = rows.withColumn("after", after).select("i", url(F.col("i")).alias("url"), F.concat(
        F.lit("<a href='/about'>about</a><a href='"), base, F.lit("1'>first</a>"), F.when(F.col("after") % 7 != 0, F.concat(F.lit("<a href='"), (F.col("i") + 1).cast("string"), F.lit("'>next</a>"))).otherwise("")).alias("html"))
    return sites.reachable(rows, rows.where("i = 1"))
