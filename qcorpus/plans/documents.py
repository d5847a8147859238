"""Text normalisation, duplicates, search and URL queries over documents, benchmark and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.stemming import STOP_WORDS
from ..operators import analytics, dedupe, gramindex, search, similarity, waves
from ..sources import pages as pg
from .registry import query, table

#: The normalised text, in DuckDB: NFC, lower case, single spaces, letters, marks, digits and spaces.
_NORM = r"trim(regexp_replace(trim(regexp_replace(lower(nfc_normalize({0})), '[\s\p{{Z}}\x1c-\x1f\x85]+', ' ', 'g')), '[^\p{{L}}\p{{M}}\p{{N}}\s]', '', 'g'))"
#: The djb2-xor hash in base 36.
_HASH = "lower(to_base(list_reduce(list_prepend(5381::BIGINT, list_transform(list_filter(string_split({0}, ''), lambda c: c <> ''), lambda x: unicode(x)::BIGINT)), lambda a, x: xor(a * 33, x) & 4294967295::BIGINT), 36))"


def norm_sql(column: str) -> str:
    return _NORM.format(column)


def hash_sql(column: str) -> str:
    return _HASH.format(column)


@query(f"WITH n AS (SELECT doc_id, {norm_sql('text')} AS norm FROM documents) SELECT doc_id, length(norm)::INT AS norm_chars, {hash_sql('norm')} AS content_hash FROM n")
def norm_hash_docs(spark, sf_dir):
    norm = table(spark, sf_dir, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("norm"))
    return norm.select("doc_id", F.length("norm").alias("norm_chars"), tx.content_hash(F.col("norm")).alias("content_hash"))


@query(f"""
WITH n AS (SELECT doc_id, {norm_sql('text')} AS norm FROM documents), g AS (SELECT norm, count(*) AS n, min(doc_id) AS first_id FROM n GROUP BY norm HAVING count(*) > 1)
SELECT {hash_sql('norm')} AS content_hash, n, first_id FROM g
""")
def dup_exact_groups(spark, sf_dir):
    return dedupe.exact_groups(table(spark, sf_dir, "documents"), "doc_id", "text").select("content_hash", "n", "first_id")


@query(f"""
WITH b AS (SELECT DISTINCT {norm_sql('text')} AS norm FROM documents WHERE doc_id % 2 = 1), e AS (SELECT DISTINCT {norm_sql('text')} AS norm FROM documents WHERE doc_id % 2 = 0)
SELECT count(*) FILTER (norm NOT IN (SELECT norm FROM e)) AS new_count, count(*) FILTER (norm IN (SELECT norm FROM e)) AS existing_count FROM b WHERE norm <> ''
""")
def novelty_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("norm"))
    return analytics.novelty(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0"), "norm")


@query(f"""
WITH n AS (SELECT doc_id, {norm_sql('text')} AS norm FROM documents), w AS (SELECT doc_id, unnest(string_split(norm, ' ')) AS w FROM n)
SELECT doc_id, count(*) FILTER (regexp_full_match(w, '\\d+')
  OR w IN ('zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve',
    'first', 'second', 'third', 'fourth', 'fifth', 'single', 'double', 'triple', 'once', 'twice')) AS n_numbers
FROM w GROUP BY doc_id
""")
def numbers_in_text(spark, sf_dir):
    norm = tx.normalize_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.numbers_in(norm)).cast("long").alias("n_numbers"))


@query("""
WITH p AS (SELECT p_partkey AS id, p_name AS text FROM part), w AS (SELECT id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS w FROM p),
g AS (SELECT DISTINCT id, ('  ' || w || ' ')[i:i + 2] AS gram FROM w, unnest(range(1, length(w) + 2)) u(i) WHERE w <> ''),
s AS (SELECT id, count(*) AS n FROM g GROUP BY id),
o AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram WHERE a.id % 20 = 0 GROUP BY 1, 2),
j AS (SELECT a, b, shared / (x.n + y.n - shared)::DOUBLE AS trigram FROM o JOIN s x ON x.id = a JOIN s y ON y.id = b),
l AS (SELECT j.*, length(x.text) AS la, length(y.text) AS lb FROM j JOIN p x ON x.id = a JOIN p y ON y.id = b),
r AS (SELECT a, b, trigram, row_number() OVER (PARTITION BY a ORDER BY trigram DESC, b) AS place FROM l WHERE trigram >= 0.3 AND least(la, lb) >= greatest(la, lb) * (0.9 * 0.85))
SELECT a, b, round(trigram, 9) AS trigram, place::INT AS place FROM r WHERE place <= 50
""")
def trigram_top_candidates(spark, sf_dir):
    """The stated probes, every twentieth part, against all parts."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    found = similarity.top_candidates(parts.where("id % 20 = 0"), parts, 0.9)
    return found.select("a", "b", F.round("trigram", 9).alias("trigram"), "place")


@query("""
WITH c AS (SELECT p_partkey AS id, false AS variant, p_name AS text FROM part UNION ALL SELECT p_partkey, true, p_brand || ' ' || p_name FROM part),
t AS (SELECT DISTINCT text FROM c), w AS (SELECT text, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS w FROM t),
g AS (SELECT DISTINCT text, ('  ' || w || ' ')[i:i + 2] AS gram FROM w, unnest(range(1, length(w) + 2)) u(i) WHERE w <> ''),
s AS (SELECT text, count(*) AS n FROM g GROUP BY text), p AS (SELECT p_partkey AS a, p_name AS text FROM part WHERE p_partkey % 20 = 0),
o AS (SELECT a.text AS x, b.text AS y, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram WHERE a.text IN (SELECT text FROM p) GROUP BY 1, 2),
j AS (SELECT x, y, shared / (u.n + v.n - shared)::DOUBLE AS trigram FROM o JOIN s u ON u.text = x JOIN s v ON v.text = y),
r AS (SELECT a, id AS owner, variant, trigram, row_number() OVER (PARTITION BY a ORDER BY trigram DESC, id, variant) AS place
  FROM j JOIN p ON p.text = x JOIN c ON c.text = y WHERE trigram >= 0.3 AND least(length(x), length(y)) >= greatest(length(x), length(y)) * (0.9 * 0.85))
SELECT a, owner, variant, round(trigram, 9) AS trigram, place::INT AS place FROM r WHERE place <= 50
""")
def indexed_candidates(spark, sf_dir):
    """The stated probes against a kept index of all part names, to which names with their brands are added as variants."""
    parts = table(spark, sf_dir, "part")
    named = parts.select(F.col("p_partkey").alias("owner"), F.col("p_name").alias("text"), F.lit(False).alias("variant"))
    wordings = parts.select(F.col("p_partkey").alias("owner"), F.concat_ws(" ", "p_brand", "p_name").alias("text"), F.lit(True).alias("variant"))
    index = gramindex.new_index(spark).drop_at_end().build(named)
    index.insert(wordings)
    found = index.top(parts.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), 0.9)
    return found.select("a", "owner", "variant", F.round("trigram", 9).alias("trigram"), "place")


@query()
def near_dup_items(spark, sf_dir):
    """The audit of all conversation turns: copies, equal wording in another role, and similar texts."""
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    shaped = turns.select(F.struct("conv_id", "turn").alias("id"), "text", F.array("role").alias("options"), F.array(F.lit("a")).alias("answers"))
    other = F.col("b.conv_id").alias("other_conv"), F.col("b.turn").alias("other_turn")
    return dedupe.audit(shaped).select("kind", "a.*", *other, "similarity", "options_match", "answer_match")


@query(f"""
WITH r AS (SELECT p_partkey AS id, {norm_sql("p_name || ' ' || p_brand")} AS norm, p_type AS o FROM part), s AS (SELECT norm, o, min(id) AS id FROM r GROUP BY 1, 2),
t AS (SELECT norm, arg_min(o, id) AS o, min(id) AS id FROM s GROUP BY 1),
n AS (SELECT a.norm AS x, b.norm AS y, 1 - levenshtein(a.norm, b.norm) / greatest(length(a.norm), length(b.norm))::DOUBLE AS sim FROM t a JOIN t b ON a.id < b.id),
f AS (SELECT 'exact' AS kind, s.id AS p, r.id AS q, 1.0::DOUBLE AS sim, true AS options_match FROM s JOIN r USING (norm, o) WHERE s.id <> r.id
UNION ALL SELECT 'same_wording', t.id, s.id, 1.0, false FROM t JOIN s USING (norm) WHERE t.id <> s.id
UNION ALL SELECT 'similar', u.id, v.id, sim, u.o = v.o FROM n JOIN s u ON u.norm = x JOIN s v ON v.norm = y WHERE sim >= 0.85)
SELECT kind, least(p, q) AS a, greatest(p, q) AS b, round(sim, 9) AS similarity, options_match FROM f
""")
def near_dup_parts(spark, sf_dir):
    """The audit of part names with their brands: copies, equal names of another type, and similar names."""
    name = F.concat_ws(" ", "p_name", "p_brand")
    shaped = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("text"), F.array("p_type").alias("options"), F.array(F.lit("a")).alias("answers"))
    return dedupe.audit(shaped).select("kind", "a", "b", F.round("similarity", 9).alias("similarity"), "options_match")


def benchmark_items(spark, sf_dir):
    """The benchmark as part of a corpus for decisions on conversation turns."""
    none = F.array().cast("array<string>")
    items = table(spark, sf_dir, "benchmark").where("text is not null")
    return items.select((-1 - F.col("item_id")).alias("id"), "text", none.alias("options"), none.alias("answers"), F.lit(None).cast("long").alias("conv_id"))


def part_batches(spark, sf_dir):
    """Part names with their brands as incoming questions in batches by brand; a part's place in a paper is its type and key."""
    none = F.lit(None)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("batch"), F.col("p_partkey").cast("int").alias("position"), F.concat_ws(" ", "p_name", "p_brand").alias("text"),
        F.array("p_type").alias("options"), F.array(F.substring("p_type", 1, 1)).alias("answers"), F.concat_ws("-", "p_type", F.col("p_partkey").cast("string")).alias("stable_id"),
        F.col("p_type").alias("question_set"), none.cast("int").alias("number"), F.round("p_retailprice", 0).alias("marks"), none.cast("double").alias("negative_marks"), F.lit("scored").alias("answer_status"),
        F.array(F.struct(F.concat(F.lit("img/"), "p_type").alias("storage_key"), F.lit(0).alias("position"))).alias("media"), (F.col("p_size") > 1).alias("valid"))


def empty_store(spark, stored_questions):
    empty = lambda schema: spark.createDataFrame([], schema)
    return waves.Store(
        stored_questions, empty("question_id long, text string"),
        empty("question_id long, question_set_id string, number int, marks decimal(5,2), negative_marks decimal(5,2), answer_status string"), empty("question_id long, storage_key string, position int"))


@query()
def publish_waves(spark, sf_dir):
    """The part names published in order against the benchmark's items: what becomes of each."""
    items = benchmark_items(spark, sf_dir).select("id", F.lit(None).cast("string").alias("stable_id"), "text", "options", "answers")
    report, _ = waves.publish_in_order(part_batches(spark, sf_dir), empty_store(spark, items))
    return report


@query()
def dedupe_decisions(spark, sf_dir):
    """Decisions for the conversation turns against the benchmark and all turns of other conversations.

    A benchmark item has the id -1 - item_id, and neither options nor answers.
    """
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    probes = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.array("role").alias("options"), F.array(F.lit("a")).alias("answers"), "conv_id")
    corpus = probes.unionByName(benchmark_items(spark, sf_dir))
    return dedupe.decide(probes, corpus, apart="conv_id").select("probe", "outcome", "existing", "similarity", "options_match", "answer_match", "suggestion")


@query(f"""
WITH RECURSIVE b AS (SELECT 'conversation ' || conv_id AS batch, turn AS position, {norm_sql('text')} AS norm FROM conversations WHERE text IS NOT NULL
UNION ALL SELECT p_brand || ' ' || p_size, p_partkey, {norm_sql('p_name')} FROM part),
e AS (SELECT x.batch, x.position AS p, y.position AS q FROM b x JOIN b y ON x.batch = y.batch AND x.position < y.position
  WHERE least(length(x.norm), length(y.norm)) >= 0.9 * greatest(length(x.norm), length(y.norm)) AND 1 - levenshtein(x.norm, y.norm) / greatest(length(x.norm), length(y.norm))::DOUBLE >= 0.9),
w(batch, position, wave) AS (SELECT batch, position, 0 FROM b UNION SELECT e.batch, e.q, w.wave + 1 FROM w JOIN e ON e.batch = w.batch AND e.p = w.position)
SELECT batch, position, max(wave)::INT AS wave FROM w GROUP BY batch, position
""")
def batch_waves(spark, sf_dir):
    """Publish waves of the turns of each conversation, and of the part names of each brand and size."""
    turns = table(spark, sf_dir, "conversations").where("text is not null").select(F.concat(F.lit("conversation "), "conv_id").alias("batch"), F.col("turn").alias("position"), "text")
    parts = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("batch"), F.col("p_partkey").alias("position"), F.col("p_name").alias("text"))
    return dedupe.plan_waves(turns.unionByName(parts))


@query(f"""
SELECT 'documents' AS origin, count(*) AS n, count(DISTINCT {norm_sql('text')}) AS texts FROM documents
UNION ALL SELECT 'benchmark', count(*), count(DISTINCT {norm_sql('text')}) FROM benchmark
""")
def union_candidates(spark, sf_dir):
    both = None
    for name in ("documents", "benchmark"):
        rows = table(spark, sf_dir, name).select(F.lit(name).alias("origin"), tx.normalize_text(F.col("text")).alias("norm"))
        both = rows if both is None else both.unionByName(rows)
    return both.groupBy("origin").agg(F.count("*").alias("n"), F.countDistinct("norm").alias("texts"))


#: The rank of positions in DuckDB; the forms of a query's words are spelled out, so the stems are the engine's alone.
_RANKED = r"""
WITH d AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS body FROM documents WHERE text IS NOT NULL),
ta AS (SELECT id, list_filter(string_split_regex(lower(title), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM d),
tb AS (SELECT id, list_filter(string_split_regex(lower(body), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM d),
a AS (SELECT id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM ta), b AS (SELECT id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM tb),
m AS (SELECT id, max(p) AS m FROM a WHERE NOT list_contains(STOPS, w) GROUP BY id),
u AS (SELECT id, w, least(p, 16383) AS p, 1.0 AS g FROM a UNION ALL SELECT b.id, w, least(p + coalesce(m, 0), 16383), 0.4 FROM b LEFT JOIN m USING (id)),
k(query, lexeme, form) AS (VALUES ('worthless clowns', 1, 'worthless(ly|ness)?'), ('worthless clowns', 2, 'clown(s|ed|ing)?'), ('licensing', 1, 'licens(e|es|ed|ing)'),
  ('stupid, worthless idiots', 1, 'stupid(s|ly)?'), ('stupid, worthless idiots', 2, 'worthless(ly|ness)?'), ('stupid, worthless idiots', 3, 'idiots?')),
n AS (SELECT query, count(*) AS need FROM k GROUP BY query),
h AS (SELECT query, lexeme, id, p, g, row_number() OVER (PARTITION BY query, lexeme, id ORDER BY p) AS r FROM u JOIN k ON regexp_full_match(w, form)),
f AS (SELECT query, id, need FROM h JOIN n USING (query) GROUP BY query, id, need HAVING count(DISTINCT lexeme) = need),
one AS (SELECT query, id, sum(g / (r * r)) / 1.64493406685 AS score FROM h JOIN f USING (query, id) WHERE need = 1 GROUP BY query, id),
two AS (SELECT x.query, x.id, 1 - product(1 - sqrt(x.g * y.g * CASE WHEN abs(x.p - y.p) > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(abs(x.p - y.p) / 1.5 - 2)) END)) AS score
  FROM h x JOIN h y ON x.query = y.query AND x.id = y.id AND x.lexeme < y.lexeme JOIN f ON f.query = x.query AND f.id = x.id WHERE need > 1 GROUP BY x.query, x.id),
r AS (SELECT query, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, id) AS place FROM (SELECT * FROM one UNION ALL SELECT * FROM two))
SELECT query, id, score, place::INT AS place FROM r WHERE place <= 20
""".replace("STOPS", "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]")


def _titled(spark, sf_dir):
    """Documents with their first line as title and the rest as body, and the stated queries."""
    title = F.substring_index("text", "\n", 1)
    docs = table(spark, sf_dir, "documents").select("doc_id", title.alias("title"), F.expr("substr(text, length(substring_index(text, '\n', 1)) + 2)").alias("body"))
    return docs, spark.sql("SELECT * FROM VALUES ('worthless clowns'), ('licensing'), ('the'), ('stupid, worthless idiots') AS t(query)")


@query(_RANKED)
def fts_search(spark, sf_dir):
    """A top-k report for stated queries over titles and bodies of all documents, in one pass over them."""
    docs, asked = _titled(spark, sf_dir)
    return search.scan(docs, "doc_id", ["title", "body"], search.WEIGHTS, asked, 20)


@query(_RANKED)
def indexed_search(spark, sf_dir):
    """The same report from kept postings of all documents."""
    docs, asked = _titled(spark, sf_dir)
    return search.new_index(spark).drop_at_end().add(docs, "doc_id", ["title", "body"]).search(asked, 20)


@query("""
WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '') AS host FROM pages)
SELECT page_id, CASE WHEN host LIKE 'm.%' AND host LIKE '%.example.com' THEN 'com' WHEN host LIKE '%.example.com' THEN 'com'
  WHEN host LIKE '%.example.net' THEN 'net' ELSE 'default' END AS profile
FROM h
""")
def host_profile_join(spark, sf_dir):
    profiles = spark.sql("SELECT * FROM VALUES ('example.com', 'com'), ('example.net', 'net') AS t(host, profile)")
    return pg.profile_for_url(table(spark, sf_dir, "pages"), profiles).select("page_id", "profile")


@query("""
SELECT page_id FROM pages WHERE regexp_matches(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '(^|\\.)example\\.(com|net)$')
""")
def allowed_urls(spark, sf_dir):
    sources = spark.sql("SELECT * FROM VALUES ('example.com', true), ('example.net', true), ('example.org', false) AS t(host, enabled)")
    return pg.allowed_urls(table(spark, sf_dir, "pages"), sources).select("page_id")


@query("""
WITH l AS (SELECT DISTINCT url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
SELECT count(*) AS links, count(DISTINCT url) AS pages FROM (
  SELECT DISTINCT url, regexp_extract(url, '^(https?://[^/?#]+)', 1) || href FROM l WHERE href LIKE '/%' AND href NOT LIKE '//%'
)
""")
def link_discovery(spark, sf_dir):
    found = pg.links(table(spark, sf_dir, "pages"))
    return found.agg(F.count("*").alias("links"), F.countDistinct("url").alias("pages"))


@query("""
WITH t AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS x FROM pages)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM t
""")
def html_plain_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", pg.plain_text(F.col("html")).alias("text"))


_NAME_HITS = """
WITH w AS (SELECT p_partkey AS id, unnest(string_split_regex(lower(p_name), '[^\\p{L}\\p{N}]+')) AS w FROM part),
k(query, form) AS (VALUES ('widgets', 'widget(s|ed|ing)?'), ('bolt', 'bolt(s|ed|ing)?')),
t AS (SELECT query, id, row_number() OVER (PARTITION BY query, id) AS r FROM w JOIN k ON regexp_full_match(w, form)),
s AS (SELECT query, id, round(sum(0.1 / (r * r)) / 1.64493406685, 6) AS score FROM t GROUP BY query, id),
h AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM s)
"""


@query(_NAME_HITS + "SELECT query, id, score, place::INT AS place FROM h WHERE place <= 10")
def name_search(spark, sf_dir):
    """A top-k report of part names for stated queries."""
    asked = spark.sql("SELECT * FROM VALUES ('widgets'), ('bolt') AS t(query)")
    return search.name_search(table(spark, sf_dir, "part"), "p_partkey", "p_name", asked)


@query(_NAME_HITS + """
SELECT q.query, count(h.id) FILTER (place <= 10) AS result_count FROM (VALUES ('widgets'), ('bolt'), ('nosuchname')) q(query) LEFT JOIN h USING (query) GROUP BY 1
""")
def search_log(spark, sf_dir):
    """What the stated queries found; blank ones are not logged."""
    asked = spark.sql("SELECT * FROM VALUES ('widgets'), ('bolt'), ('nosuchname'), ('  ') AS t(query)")
    return search.search_log(asked, search.name_search(table(spark, sf_dir, "part"), "p_partkey", "p_name", asked))


@query("""
WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages)
SELECT DISTINCT ON (url) url, title, nullif(regexp_extract(title, '\\b([A-Z]{2,4}-\\d{2,4})\\b', 1), '') AS code FROM p ORDER BY url, page_id
""")
def catalog_rows(spark, sf_dir):
    return pg.catalog_rows(table(spark, sf_dir, "pages"))


@query(f"""
WITH t AS (SELECT source, {norm_sql('text')} AS n FROM documents WHERE text IS NOT NULL), g AS (SELECT n FROM t GROUP BY n HAVING count(*) > 1)
SELECT source, count(*) AS repeated FROM t JOIN g USING (n) GROUP BY source
""")
def exact_candidates(spark, sf_dir):
    """Documents whose text some other has too, by hash and confirmed on the normalised text."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    probes = docs.select(F.struct("doc_id", "source").alias("id"), "text")
    found = dedupe.find_exact(probes, docs.select(F.col("doc_id").alias("id"), "text")).where("copies > 1")
    return found.groupBy(F.col("probe.source").alias("source")).agg(F.count("*").alias("repeated"))
