"""Links, quizzes and notices from landed HTML pages, and the checks on their URLs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import host
from ..storage import stored

LINK = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Distinct (source url, absolute target) pairs; fragments and other schemes are left out."""
    rows = pages.select(F.col(url_col).alias("url"), F.explode(F.array_distinct(F.regexp_extract_all(html_col, F.lit(LINK)))).alias("href"))
    rows = rows.withColumn("href", F.regexp_replace(F.trim(F.replace("href", F.lit("&amp;"), F.lit("&"))), r"#.*$", ""))
    rows = rows.where((F.col("href") != "") & ~F.col("href").rlike(r"(?i)^(?:javascript|mailto|data|tel):"))
    site = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract("url", r"^(https?://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    target = (
        F.when(F.col("href").rlike(r"^https?://"), F.col("href")).when(F.startswith("href", F.lit("//")), F.concat(F.lit("https:"), "href"))
        .when(F.startswith("href", F.lit("/")), F.concat(site, "href")).otherwise(F.concat(folder, "href"))
    )
    return rows.select("url", target.alias("target")).distinct()


def _suffixes(hosts: DataFrame) -> DataFrame:
    """(_host, _suffix): a host and each domain that it is or is below, to be joined by equality."""
    parts = F.split("_host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))
    return hosts.select("_host").distinct().withColumn("_suffix", F.explode(ends))


def allowed_urls(urls: DataFrame, sources: DataFrame, url_col: str = "url") -> DataFrame:
    """URLs whose host is, or is below, the host of an enabled source."""
    named = urls.withColumn("_host", host(F.col(url_col)))
    hosts = sources.where("enabled").select(F.col("host").alias("_suffix")).distinct()
    known = _suffixes(named).join(hosts, "_suffix").select("_host").distinct()
    return named.join(known, "_host", "left_semi").drop("_host")


def profile_for_url(urls: DataFrame, profiles: DataFrame, url_col: str = "url") -> DataFrame:
    """Add the ``profile`` of the longest host of (host, profile) that matches, else "default".

    Hosts and their profiles are stored, so that pages, which may be all of a few hosts, are not shuffled by host to meet a small table.
    """
    named = urls.withColumn("_host", host(F.col(url_col)))
    found = _suffixes(named).join(profiles.select(F.col("host").alias("_suffix"), "profile"), "_suffix")
    best = found.groupBy("_host").agg(F.max_by("profile", F.length("_suffix")).alias("profile"))
    return named.join(stored(best, "hosts"), "_host", "left").withColumn("profile", F.coalesce("profile", F.lit("default"))).drop("_host")


def plain_text(html: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags; a small set of references is read."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _happened(sentence: Column) -> Column:
    """A form of "to be" stands right before the word "retired": it has happened, and does not lie ahead."""
    words = F.split(F.lower(sentence), r"[^a-z]+")
    word = lambda i: F.coalesce(F.get(words, i), F.lit(""))
    present = lambda i: word(i - 1).isin("is", "are", "was", "were") | ((word(i - 1) == "been") & word(i - 2).isin("has", "have"))
    return F.exists(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (word(i) == "retired") & present(i))


def retirement_notice(html: Column) -> Column:
    """The sentences on an exam's end and successor in the first warning box by which it has ended; null without such a box.

    A box is a ``div`` of the class "warning"; its heading is no sentence.
    """
    parts = F.filter(F.split(html, r"(?i)(?=<div\b)"), lambda d: F.array_contains(
        F.split(F.lower(F.regexp_extract(d, r"(?is)^<div\b[^>]*?\bclass\s*=\s*[\"']?([^\"'>]*)", 1)), r"\s+"), "warning"))
    boxes = F.transform(parts, lambda d: F.split(plain_text(F.regexp_extract(d, r"(?is)^(.*?)(?:</div|\z)", 1)), r"(?<=[.!?])\s+"))
    ended = F.get(F.filter(boxes, lambda sentences: F.exists(sentences, _happened)), F.lit(0))
    telling = F.filter(ended, lambda x: F.contains(F.lower(x), F.lit("retired")) | F.contains(F.lower(x), F.lit("replaced by")))
    return F.array_join(F.transform(telling, lambda x: F.regexp_replace(x, r"^Warning\s+", "")), " ")


class _Quiz(HTMLParser):
    """Fieldsets with a legend, labelled choices and a mark on the correct ones."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.questions: list[dict] = []
        self.into: list[str] | None = None
        self.into_tag = ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        names = (dict(attrs).get("class") or "").split()
        if tag == "fieldset":
            self.questions.append({"stem": [], "options": [], "rationale": []})
        elif self.questions and self.into is None:
            q = self.questions[-1]
            if tag == "legend" or "stem" in names:
                self.into, self.into_tag = q["stem"], tag
            elif tag == "label":
                q["options"].append({"text": [], "correct": "is-correct" in names})
                self.into, self.into_tag = q["options"][-1]["text"], tag
            elif "rationale" in names:
                self.into, self.into_tag = q["rationale"], tag
        if self.into is not None and "is-correct" in names and self.questions and self.questions[-1]["options"]:
            self.questions[-1]["options"][-1]["correct"] = True

    def handle_endtag(self, tag: str) -> None:
        if tag == self.into_tag:
            self.into = None

    def handle_data(self, data: str) -> None:
        if self.into is not None:
            self.into.append(data)


QUIZ_SCHEMA = (
    "url string, number int, question_text string, options array<struct<key:string,text:string>>, "
    "correct_keys array<string>, explanation string, error string"
)


def quiz_questions(html: str) -> list[dict]:
    """Questions of a page. Nothing is made up: fewer than two options or no correct one is an error."""
    parser = _Quiz()
    parser.feed(html)
    out = []
    text = lambda parts: " ".join("".join(parts).split())
    for number, q in enumerate(parser.questions, 1):
        seen: dict[str, bool] = {}
        for o in q["options"]:
            name = text(o["text"])
            if name:
                seen[name] = seen.get(name, False) or o["correct"]
        options = [{"key": chr(65 + i), "text": t} for i, t in enumerate(seen)]
        keys = [o["key"] for o, right in zip(options, seen.values()) if right]
        error = "fewer than two options" if len(options) < 2 else "no correct option" if not keys else None
        out.append({"number": number, "question_text": text(q["stem"]), "options": options, "correct_keys": keys, "explanation": text(q["rationale"]) or None, "error": error})
    return out


_ARROW = pa.schema([
    ("url", pa.string()), ("number", pa.int32()), ("question_text", pa.string()),
    ("options", pa.list_(pa.struct([("key", pa.string()), ("text", pa.string())]))), ("correct_keys", pa.list_(pa.string())),
    ("explanation", pa.string()), ("error", pa.string()),
])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [{"url": u} | q for u, h in zip(*(batch.column(c).to_pylist() for c in ("url", "html"))) for q in quiz_questions(h or "")]
        yield from pa.Table.from_pylist(rows, _ARROW).to_batches()


def parse_quizzes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per question of each page; what cannot be one has ``error`` set."""
    return pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(_parse, QUIZ_SCHEMA)


def replay(artifacts: DataFrame, source: str | None = None, since: str | None = None, parser: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Stored artifacts to parse again, by optional source and first time of fetching; parsed, where a parser is given."""
    if source is not None:
        artifacts = artifacts.where(F.col("source") == source)
    if since is not None:
        artifacts = artifacts.where(F.col("fetched_at") >= F.lit(since).cast("timestamp"))
    return parser(artifacts) if parser else artifacts


def catalog_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, title, code) of a catalog's pages, once for each URL without query and fragment: the first page's."""
    title = F.trim(F.regexp_replace(F.regexp_extract(html_col, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    code = F.nullif(F.regexp_extract(title, r"\b([A-Z]{2,4}-\d{2,4})\b", 1), F.lit(""))
    rows = pages.select(F.regexp_replace(url_col, r"[?#].*$", "").alias("url"), F.struct(F.col(id_col).alias("id"), title.alias("title"), code.alias("code")).alias("r"))
    return rows.groupBy("url").agg(F.min("r").alias("r")).select("url", "r.title", "r.code")
