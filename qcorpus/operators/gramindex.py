"""A kept trigram index over questions and their variants, probed without being built again.

``texts`` has each distinct text once, under a 128-bit digest; ``owners`` tells whose it is, a question's own or a
variant's wording; ``postings`` has a row for each trigram of a text, bucketed by the trigram, with the trigram's
place among the text's own from rare to frequent. That order is fixed when the index is first filled
(``order``; trigrams that were not there then are the rarest), so what is added later
agrees with it: a pair with a Jaccard similarity of t shares one of the first n - ceil(t * n) + 1 trigrams
of either text, whatever the order, as long as both have the same.

A probe shuffles its own trigrams to the postings' buckets, meets those within the prefix and the
length band, and verifies what it finds on the texts. Adding texts writes only what is new.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import trigrams
from ..storage import Postings, new_path, stored
from .similarity import TRIGRAM_CUTOFF

_SCHEMAS = {
    "texts": ("tid", "tid binary, text string, n int"),
    "owners": ("tid", "tid binary, owner {0}, variant boolean"),
    "postings": ("gram", "gram bigint, tid binary, len int, n int, place int"),
    "order": ("gram", "gram bigint, df bigint"),
}


def _tid(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def _hashed(text: Column) -> Column:
    return F.transform(trigrams(text), lambda g: F.xxhash64(g))


def _first(n: Column, cutoff: float) -> Column:
    """So many of n trigrams a similar text cannot miss."""
    return n - F.ceil(n * cutoff - 1e-9).cast("int") + 1


@dataclass
class TrigramIndex:
    spark: SparkSession
    path: str
    buckets: int = 64
    cutoff: float = TRIGRAM_CUTOFF

    def _part(self, name: str) -> Postings:
        own = f"grams_{crc32(self.path.encode()):08x}_{name}"
        return Postings(self.spark, f"{self.path}/{name}", own, _SCHEMAS[name][0], self.buckets)

    def open(self, owner_type: str = "bigint") -> TrigramIndex:
        """An index that an earlier session has left at the path."""
        for name, (_, schema) in _SCHEMAS.items():
            self._part(name).open(schema.format(owner_type))
        return self

    def drop_at_end(self) -> TrigramIndex:
        for name in _SCHEMAS:
            self._part(name).drop_at_end()
        return self

    def _ranked(self, grams: DataFrame) -> DataFrame:
        """(tid, len, n, gram, place) of (tid, len, gram), places from 1 by the index's order."""
        order = self._part("order").table()
        known = grams.join(order, "gram", "left").select("tid", "len", "gram", F.coalesce("df", F.lit(0)).alias("df"))
        lists = known.groupBy("tid", "len").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("g"))
        return lists.select("tid", "len", F.size("g").alias("n"), F.posexplode("g").alias("p", "x")).select("tid", "len", "n", F.col("x.gram").alias("gram"), (F.col("p") + 1).alias("place"))

    @staticmethod
    def _grams(texts: DataFrame) -> DataFrame:
        return texts.select("tid", F.length("text").alias("len"), F.explode(_hashed(F.col("text"))).alias("gram"))

    def build(self, rows: DataFrame) -> TrigramIndex:
        """Fill a new index with (owner, text, variant); null texts are left out."""
        texts = rows.where("text is not null").select(_tid(F.col("text")).alias("tid"), "text").dropDuplicates(["tid"])
        grams = self._grams(texts)
        self._part("order").add(grams.groupBy("gram").agg(F.count("*").alias("df")))
        self._write(rows, texts)
        return self

    def insert(self, rows: DataFrame) -> None:
        """Add rows; those that the index has already change nothing."""
        named = rows.where("text is not null").select(_tid(F.col("text")).alias("tid"), "text", "owner", "variant").distinct()
        have = self._part("owners").table().select("tid", "owner", "variant")
        fresh = stored(named.join(have, ["tid", "owner", "variant"], "left_anti"), "fresh")
        texts = fresh.select("tid", "text").dropDuplicates(["tid"]).join(self._part("texts").table().select("tid"), "tid", "left_anti")
        self._write(fresh, stored(texts, "texts"))

    def _write(self, rows: DataFrame, texts: DataFrame) -> None:
        owners = rows.where("text is not null").select(_tid(F.col("text")).alias("tid"), "owner", "variant").distinct()
        self._part("postings").add(self._ranked(self._grams(texts)).select("gram", "tid", "len", "n", "place"))
        self._part("texts").add(texts.select("tid", "text", F.size(trigrams(F.col("text"))).alias("n")))
        self._part("owners").add(owners.select("tid", "owner", "variant"))

    def pairs(self, probes: DataFrame, min_similarity: float) -> DataFrame:
        """(text, tid, other, trigram): distinct probe texts and indexed ones that reach the cutoff, within the length band of ``min_similarity``."""
        asked = stored(probes.where("text is not null").select(_tid(F.col("text")).alias("tid"), "text").dropDuplicates(["tid"]), "asked")
        band = min_similarity * 0.85  # wider than the score's, as it is set before texts are cleaned
        own = self._ranked(self._grams(asked)).where(F.col("place") <= _first(F.col("n"), self.cutoff)).select(
            "gram", F.col("tid").alias("probe"), F.col("len").alias("l"), F.col("n").alias("m"))
        posted = self._part("postings").table().where(F.col("place") <= _first(F.col("n"), self.cutoff))
        fits = (F.least("len", "l") >= F.greatest("len", "l") * band) & (F.least("n", "m") >= F.greatest("n", "m") * self.cutoff - 1e-9)
        met = own.join(posted, "gram").where(fits).select("probe", "tid").distinct()
        found = met.join(asked.select(F.col("tid").alias("probe"), F.col("text"), _hashed(F.col("text")).alias("g")), "probe")
        found = found.join(self._part("texts").table().select("tid", F.col("text").alias("other"), _hashed(F.col("text")).alias("h")), "tid")
        shared = F.size(F.array_intersect("g", "h"))
        found = found.withColumn("trigram", F.coalesce(F.try_divide(shared, F.size("g") + F.size("h") - shared), F.lit(0.0)))
        return found.where(F.col("trigram") >= self.cutoff).select("text", "tid", "other", "trigram")

    def top(self, probes: DataFrame, min_similarity: float, limit: int = 50) -> DataFrame:
        """The ``limit`` most similar rows of the index for each probe (id, text), a top-k report: a, owner, variant, other, trigram, place."""
        named = self._part("owners").table()
        # no more than ``limit`` of the rows that share a text can be in a report
        first = F.row_number().over(W.partitionBy("tid").orderBy("owner", "variant"))
        named = named.withColumn("_n", first).where(F.col("_n") <= limit).drop("_n")
        found = self.pairs(probes, min_similarity).join(named, "tid")
        place = F.row_number().over(W.partitionBy("text").orderBy(F.desc("trigram"), "owner", "variant"))
        best = found.withColumn("place", place).where(F.col("place") <= limit)
        return probes.select(F.col("id").alias("a"), "text").join(best, "text").select("a", "owner", "variant", "other", "trigram", "place")


def new_index(spark: SparkSession, buckets: int = 64) -> TrigramIndex:
    """An index in the shared folder, for as long as the application."""
    return TrigramIndex(spark, new_path(spark, "grams"), buckets)
