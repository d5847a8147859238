"""Browse views over the catalog star: occurrences with context, latest rows, sitemaps, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def star(fact: DataFrame, inner: list[tuple[DataFrame, str, str]], left: list[tuple[DataFrame, str, str]] = ()) -> DataFrame:
    """A fact table with its dimensions: (table, fact key, dimension key), required or optional.

    Whether a dimension is broadcast is left to Spark, which knows its size.
    """
    for how, dims in (("inner", inner), ("left", left)):
        for dim, a, b in dims:
            fact = fact.join(dim, fact[a] == dim[b], how)
    return fact


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order (DISTINCT ON)."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def ordered_json(df: DataFrame, keys: list[str], order: list[str], fields: list[str], name: str) -> DataFrame:
    """Rows of a key as one JSON array, in order."""
    items = F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order])))
    return df.groupBy(*keys).agg(F.to_json(F.transform(items, lambda x: F.struct(*[x[f].alias(f) for f in fields]))).alias(name))


def published(df: DataFrame, status: str = "status") -> DataFrame:
    return df.where(F.col(status) == "published")


def sitemap_entries(pages: DataFrame, base: str, path: Column, changed: Column) -> DataFrame:
    """URL and last change of each page, as a sitemap lists them."""
    return pages.select(F.concat(F.lit(base.rstrip("/")), path).alias("loc"), F.date_format(changed, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("lastmod"))


def sitemap_xml(entries: DataFrame, per_file: int = 50_000) -> DataFrame:
    """Sitemap files of at most ``per_file`` URLs each: file number and XML.

    Files are cut within hash buckets of the URL, so that no task holds all of them.
    """
    from ..functions.text import escape_html

    buckets = max(1, -(-entries.count() // per_file) * 2)
    url = F.concat(F.lit("<url><loc>"), escape_html(F.col("loc")), F.lit("</loc><lastmod>"), F.col("lastmod"), F.lit("</lastmod></url>"))
    dealt = entries.withColumn("file", F.pmod(F.xxhash64("loc"), F.lit(buckets)))
    body = F.array_join(F.array_sort(F.collect_list(url)), "")
    head = '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    return dealt.groupBy("file").agg(F.concat(F.lit(head), body, F.lit("</urlset>")).alias("xml"))


def rss_items(rows: DataFrame, title: Column, link: Column, text: Column, at: Column, limit: int = 50) -> DataFrame:
    """The newest ``limit`` items as RSS <item> elements with CDATA bodies."""
    from ..functions.text import escape_html

    body = F.replace(F.coalesce(text, F.lit("")), F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    day = F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    item = F.concat(
        F.lit("<item><title>"), escape_html(title), F.lit("</title><link>"), escape_html(link), F.lit("</link><pubDate>"), day,
        F.lit("</pubDate><description><![CDATA["), body, F.lit("]]></description></item>"),
    )
    return rows.select(link.alias("link"), at.alias("published_at"), item.alias("item")).orderBy(F.desc("published_at"), "link").limit(limit)


def find_papers(papers: DataFrame, year: int | None = None, sitting: str | None = None) -> DataFrame:
    """Papers of a catalog, by optional year and sitting."""
    for name, value in (("year", year), ("sitting", sitting)):
        if value is not None:
            papers = papers.where(F.col(name) == F.lit(value))
    return papers


def flag_states(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """Feature flags: the stored value where there is one, else the default."""
    o = overrides.select("key", F.col("enabled").alias("_set"))
    return defaults.join(o, "key", "left").select("key", F.coalesce("_set", "enabled").alias("enabled"))


#: Patterns are looked up by so many of their first characters.
_ANCHOR = 8


def match_registered(names: DataFrame, registered: DataFrame) -> DataFrame:
    """Registered slug for (name, url): by slug, else by code inside the name, else by URL pattern.

    ``registered`` is a dimension of (slug, code, url_pattern). Patterns are substrings: the pieces of a URL
    that are as long as a pattern's first characters are joined to them by equality, then the whole is tested.
    """
    from ..functions.text import slugify

    keyed = names.withColumn("_slug", slugify(F.col("name"))).withColumn("_code", F.upper(F.regexp_extract("name", r"\b([A-Za-z]{2,4}-\d{2,4})\b", 1)))
    by_slug = registered.select(F.col("slug").alias("_slug"), F.col("slug").alias("s1")).distinct()
    by_code = registered.where("code is not null").groupBy(F.upper("code").alias("_code")).agg(F.min("slug").alias("s2"))
    found = keyed.join(by_slug, "_slug", "left").join(by_code, "_code", "left")
    patterns = registered.where("url_pattern is not null and url_pattern <> ''").select("url_pattern", F.col("slug").alias("s3"), F.substring("url_pattern", 1, _ANCHOR).alias("_piece"))
    rest = found.where("s1 is null and s2 is null and url is not null").select("url").distinct()
    sizes = F.array(*[F.lit(n) for n in range(1, _ANCHOR + 1)])
    rest = rest.select("url", F.explode(sizes).alias("_n")).where(F.col("_n") <= F.length("url"))
    known = patterns.select(F.length("_piece").alias("_n")).distinct()
    starts = F.sequence(F.lit(1), F.length("url") - F.col("_n") + 1)
    pieces = rest.join(known, "_n", "left_semi").select("url", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substr("url", i, F.col("_n"))))).alias("_piece"))
    by_url = pieces.join(patterns, "_piece").where(F.contains("url", "url_pattern")).groupBy("url").agg(F.min("s3").alias("s3"))
    return found.join(by_url, "url", "left").select("name", "url", F.coalesce("s1", "s2", "s3").alias("slug"))


def question_documents(questions: DataFrame, options: DataFrame, answers: DataFrame, images: DataFrame) -> DataFrame:
    """(id, question): a question's text with its options in order, the keys of all right ones, and its images in order.

    Questions have id, slug, text; options id, question_id, sequence, option_key, option_text; answers question_id, correct_option_id;
    images question_id, position, storage_key.
    """
    right = answers.where("correct_option_id is not null").select(F.col("correct_option_id").alias("id"), F.lit(True).alias("_right")).distinct()
    rows = options.join(right, "id", "left")
    ordered = F.array_sort(F.collect_list(F.struct("sequence", "id", "option_key", "option_text", F.coalesce("_right", F.lit(False)).alias("right"))))
    own = rows.groupBy("question_id").agg(ordered.alias("o"))
    shown = images.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "storage_key"))), lambda i: i["storage_key"]).alias("images"))
    keyed = lambda df: df.withColumnRenamed("question_id", "id")
    both = questions.join(keyed(own), "id", "left").join(keyed(shown), "id", "left")
    listed = F.transform("o", lambda x: F.struct(x["option_key"].alias("key"), x["option_text"].alias("text")))
    keys = F.transform(F.filter("o", lambda x: x["right"]), lambda x: x["option_key"])
    empty = lambda kind: F.array().cast(kind)
    return both.select("id", F.struct(
        "id", "slug", "text", F.coalesce(listed, empty("array<struct<key:string,text:string>>")).alias("options"),
        F.coalesce(keys, empty("array<string>")).alias("correct"), F.coalesce("images", empty("array<string>")).alias("images")).alias("question"))


def browse_documents(entities: DataFrame, occurrences: DataFrame, documents: DataFrame) -> DataFrame:
    """(slug, document): a page of an exam, topic, subject or set as JSON: its questions in order, and counts by subject and by set.

    Entities have slug and name; occurrences slug, question_id, question_set, subject, year. Questions stand by year, newest first, then set and id. An
    entity without questions has an empty list. A page is one document, so its size is that of its questions.
    """
    rows = occurrences.join(documents.withColumnRenamed("id", "question_id"), "question_id")
    place = F.struct((-F.coalesce("year", F.lit(0))).alias("newest"), "question_set", "question_id", "year", "subject", "question")
    pages = rows.groupBy("slug").agg(F.array_sort(F.collect_list(place)).alias("q"))

    def counted(column: str, name: str) -> DataFrame:
        counts = rows.where(F.col(column).isNotNull()).groupBy("slug", column).agg(F.count("*").alias("n"))
        return counts.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct(F.col(column).alias("slug"), F.col("n").alias("count")))).alias(name))

    both = entities.join(pages, "slug", "left").join(counted("subject", "subjects"), "slug", "left").join(counted("question_set", "sets"), "slug", "left")
    shown = F.transform("q", lambda x: F.struct(x["year"].alias("year"), x["question_set"].alias("set"), x["subject"].alias("subject"), x["question"].alias("question")))
    none = F.array().cast("array<struct<slug:string,count:bigint>>")
    page = lambda n, subjects, sets, questions: F.to_json(F.struct("slug", "name", n.alias("question_count"), subjects.alias("subjects"), sets.alias("sets"), questions.alias("questions")))
    empty = page(F.lit(0), none, none, F.array().cast("array<string>"))
    full = page(F.size("q"), F.coalesce("subjects", none), F.coalesce("sets", none), shown)
    return both.select("slug", F.when(F.col("q").isNull(), empty).otherwise(full).alias("document"))
