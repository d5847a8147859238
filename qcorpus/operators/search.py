"""Weighted full-text search over positional postings: all query words must match, and close ones rank higher.

Words are English stems without stop words. A posting is a lexeme of a document with its positions, each with the
weight of its field (titles 1.0, bodies 0.4). Postings are kept in a bucketed table (``new_index``) to which documents
can be added, and dealt out by document too, so that a lexeme of all documents is not one task's; a query of a few words reads their row groups.
Without an index ``scan`` finds the forms of the queries' words among all distinct words and reads the
texts once for these.

The rank is PostgreSQL's published ``ts_rank``: for one lexeme the weights of its positions, falling with the square of
their number; for several the pairs of their positions, by weight and distance. A lexeme has at most
``MOST_POSITIONS`` positions in a document, and none beyond ``LAST_POSITION``, as there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.stemming import STOP_WORDS, stem, stem_all
from ..storage import Postings, new_path, stored

WEIGHTS = (1.0, 0.4)
MOST_POSITIONS, LAST_POSITION = 256, 16_383
#: So many lexemes are looked up by their row groups, more by a join.
FEW_LEXEMES = 256


_BETWEEN = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; the last one may be empty."""
    return F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"^{_BETWEEN}", ""), _BETWEEN)


def tokens(text: Column) -> Column:
    """The words of a text that are not stop words."""
    return F.filter(words_of(text), lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def lexemes(text: Column) -> Column:
    return stem_all(tokens(text))


def _last_place(words: Column) -> Column:
    """Where the last word stands that is no stop word, 0 without one."""
    places = F.transform(words, lambda w, k: F.when((w != "") & ~w.isin(*STOP_WORDS), k + 1))
    return F.coalesce(F.array_max(places), F.lit(0))


def _placed(docs: DataFrame, id_col: str, fields: list[str], weights: tuple[float, ...]) -> DataFrame:
    """(id, word, place, weight) of the words that are no stop words; a field goes on from the last such word of those before."""
    found, after = None, None
    for name, weight in zip(fields, weights):
        words = words_of(F.col(name))
        if after is not None:  # places go on from there; as a column of its own it would be worked out for each word
            words = F.concat(F.array_repeat(F.lit(""), after), words)
        # outer, as Catalyst would work the array out twice to skip empty ones
        rows = docs.select(F.col(id_col).alias("id"), F.posexplode_outer(words).alias("k", "word")).where((F.col("word") != "") & ~F.col("word").isin(*STOP_WORDS))
        rows = rows.select("id", "word", F.least(F.col("k") + 1, F.lit(LAST_POSITION)).alias("place"), F.lit(weight).alias("weight"))
        found = rows if found is None else found.unionByName(rows)
        if name != fields[-1]:
            own = _last_place(words)
            after = own if after is None else F.greatest(own, after)
    return found


def _gathered(rows: DataFrame) -> DataFrame:
    """(lexeme, id, places) of (lexeme, id, place, weight)."""
    lists = rows.groupBy("lexeme", "id").agg(F.array_sort(F.collect_list(F.struct("place", "weight"))).alias("places"))
    return lists.withColumn("places", F.slice("places", 1, MOST_POSITIONS))


def postings(docs: DataFrame, id_col: str, fields: list[str], weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(lexeme, id, places) of all words of weighted text fields."""
    rows = _placed(docs, id_col, fields, weights)
    return _gathered(rows.select(stem(F.col("word")).alias("lexeme"), "id", "place", "weight"))


def query_lexemes(queries: DataFrame) -> DataFrame:
    """(query, lexeme), once each."""
    return queries.select("query", F.explode(F.array_distinct(lexemes(F.col("query")))).alias("lexeme")).distinct()


def rank(places: Column) -> Column:
    """The rank of a document by the arrays of places of the query's lexemes."""
    alone = lambda p: F.aggregate(
        F.transform(p, lambda x, i: F.struct(x["weight"].alias("w"), i.alias("i"))), F.struct(F.lit(0.0).alias("sum"), F.lit(-1.0).alias("most"), F.lit(0).alias("at")),
        lambda s, x: F.struct(
            (s["sum"] + x["w"] / ((x["i"] + 1) * (x["i"] + 1))).alias("sum"), F.greatest(s["most"], x["w"]).alias("most"), F.when(x["w"] > s["most"], x["i"]).otherwise(s["at"]).alias("at")),
        lambda s: (s["most"] + s["sum"] - s["most"] / ((s["at"] + 1) * (s["at"] + 1))) / 1.64493406685)
    single = F.aggregate(F.transform(places, alone), F.lit(0.0), lambda s, x: s + x) / F.size(places)
    near = lambda d: 1 / (1.005 + 0.05 * F.exp(d / 1.5 - 2))
    close = lambda d: F.when(d > 100, F.lit(1e-30)).otherwise(near(d))
    pair = lambda x, y: F.when(x["place"] == y["place"], F.lit(0.0)).otherwise(F.sqrt(x["weight"] * y["weight"] * close(F.abs(x["place"] - y["place"]))))
    apart = lambda a, b: F.aggregate(a, F.lit(1.0), lambda s, x: s * F.aggregate(b, F.lit(1.0), lambda t, y: t * (1 - pair(x, y))))
    before = lambda i: F.slice(places, F.lit(1), i)
    several = 1 - F.aggregate(
        F.transform(places, lambda p, i: F.aggregate(before(i), F.lit(1.0), lambda s, o: s * apart(p, o))), F.lit(1.0), lambda s, x: s * x)
    return F.when(F.size(places) > 1, several).otherwise(single)


def search(index: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """Per query (query) the ``limit`` best ids that have all its words, by rank: query, id, score, place."""
    return _best(query_lexemes(queries), index, limit)


def _best(words: DataFrame, index: DataFrame, limit: int) -> DataFrame:
    need = words.groupBy("query").agg(F.count("*").alias("need"))
    hits = words.join(index, "lexeme").groupBy("query", "id").agg(F.array_sort(F.collect_list(F.struct("lexeme", "places"))).alias("found"))
    full = hits.join(need, "query").where(F.size("found") == F.col("need"))
    full = full.select("query", "id", F.round(rank(F.transform("found", lambda x: x["places"])), 6).alias("score"))
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    return full.withColumn("place", place).where(F.col("place") <= limit).select("query", "id", "score", "place")


def scan(docs: DataFrame, id_col: str, fields: list[str], weights: tuple[float, ...], queries: DataFrame, limit: int = 20) -> DataFrame:
    """:func:`search` without kept postings: the forms of the queries' words are found among the distinct words, then placed in the texts."""
    words, distinct = query_lexemes(queries), None
    for f in fields:
        own = docs.select(F.explode_outer(words_of(F.col(f))).alias("word")).where("word <> ''").distinct()
        distinct = own if distinct is None else distinct.unionByName(own)
    forms = distinct.distinct().where(~F.col("word").isin(*STOP_WORDS)).withColumn("lexeme", stem(F.col("word")))
    forms = stored(forms.join(words.select("lexeme").distinct(), "lexeme", "left_semi"), "forms")
    return _best(words, _gathered(_placed(docs, id_col, fields, weights).join(forms, "word").select("lexeme", "id", "place", "weight")), limit)


class SearchIndex:
    """Kept postings of documents; adding documents adds rows, and a query of few words reads a few row groups."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32, segments: int = 4):
        from zlib import crc32

        self.segments = segments
        self.rows = Postings(spark, path, f"words_{crc32(path.encode()):08x}", "lexeme", buckets)

    def open(self, id_type: str = "bigint") -> SearchIndex:
        self.rows.open(f"lexeme string, id {id_type}, places array<struct<place:int,weight:double>>, segment int", "segment")
        return self

    def add(self, docs: DataFrame, id_col: str, fields: list[str], weights: tuple[float, ...] = WEIGHTS) -> SearchIndex:
        """Add documents that the index does not have."""
        found = postings(docs, id_col, fields, weights)
        self.rows.add(found.withColumn("segment", F.pmod(F.xxhash64("id"), F.lit(self.segments)).cast("int")), "segment")
        return self

    def search(self, queries: DataFrame, limit: int = 20) -> DataFrame:
        words = query_lexemes(queries)
        few = words.select("lexeme").distinct().limit(FEW_LEXEMES + 1).collect()
        index = self.rows.lookup([r["lexeme"] for r in few]) if len(few) <= FEW_LEXEMES else self.rows.table()
        return _best(words, index.select("lexeme", "id", "places"), limit)

    def drop_at_end(self) -> SearchIndex:
        self.rows.drop_at_end()
        return self


def new_index(spark: SparkSession, buckets: int = 32, segments: int = 4) -> SearchIndex:
    """An index in the shared folder, for as long as the application."""
    return SearchIndex(spark, new_path(spark, "words"), buckets, segments)


def name_search(names: DataFrame, id_col: str, name_col: str, queries: DataFrame, limit: int = 10) -> DataFrame:
    """Search on names alone, as for exams and topics; a name's words weigh little, as without a field's weight."""
    return scan(names, id_col, [name_col], (0.1,), queries, limit)


def search_log(queries: DataFrame, *results: DataFrame) -> DataFrame:
    """One row per query that is not blank, with the total number of results."""
    found = None
    for r in results:
        rows = r.select("query")
        found = rows if found is None else found.unionByName(rows)
    counts = found.groupBy("query").agg(F.count("*").alias("result_count"))
    asked = queries.select(F.trim("query").alias("query")).where("query <> ''").distinct()
    return asked.join(counts, "query", "left").na.fill({"result_count": 0})


def clicked(log: DataFrame, clicks: DataFrame) -> DataFrame:
    """The log (id, user_id, ..., clicked_id) after clicks (log_id, user_id, result_id, at): of a row's own user the last one counts."""
    last = clicks.groupBy(F.col("log_id").alias("id"), F.col("user_id").alias("_user")).agg(F.max_by("result_id", F.struct("at", "result_id")).alias("_clicked"))
    both = log.join(last.withColumnRenamed("id", "_id"), (F.col("id") == F.col("_id")) & F.col("user_id").eqNullSafe(F.col("_user")), "left")
    return both.select(*[F.coalesce("_clicked", "clicked_id").alias(c) if c == "clicked_id" else F.col(c) for c in log.columns])
