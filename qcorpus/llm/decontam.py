"""Benchmark decontamination by size-partitioned MinHash containment search.

A long document and a short test item have a tiny Jaccard similarity, so comparing their MinHash
signatures finds nothing. Instead the item alone is sketched: its signature holds, for each of m
hash functions, the shingle of the item with the smallest hash, and the document is asked which
of those shingles it contains. The expected share of hits is the containment of the item in the
document (containment MinHash), whatever the document's length. Items are partitioned by their
number of shingles: the smallest class keeps every shingle, the larger ones a sketch whose size
and least number of hits are set per class so that a containment at the threshold is missed with
a probability under 1e-7. Candidates are verified by exact shingle containment.

All of it is DataFrame code. The documents' words are read in one pass that is joined to the
sketches; the sketches and the candidates' ids are broadcast only below a checked number of
rows, else both sides are shuffled.

Defined cases: words are runs of letters and digits, lower-cased; items of fewer than ``n`` words
have no shingle and match nothing; null texts are empty; rows that share an item id are one item
whose shingles are united, and likewise for documents; rows without an id are left out; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Most rows, and bytes of strings in them, of a table that is broadcast.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
#: Size classes of items: (most shingles, hash functions, least hits at a threshold of 0.8).
#: With 32 independent functions a containment of 0.8 gives under 12 hits with probability 3e-8.
SIZE_CLASSES = ((16, None, None), (64, 32, 12), (256, 48, 20), (None, 64, 30))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _window(word: Column, i: Column, n: int) -> list[Column]:
    return [word, *[F.get(F.col("_words"), i + j) for j in range(1, n)]]


def _shingles(df: DataFrame, text: Column, n: int, hashed: bool) -> DataFrame:
    """One row for each n-word shingle of ``text``, as a 64-bit hash or as a string.

    The outer explode keeps Catalyst from pushing a filter on the array's size below the
    projection of the words, where the words would be split anew for each shingle.
    """
    join = (lambda p: F.xxhash64(*p)) if hashed else (lambda p: F.concat_ws(" ", *p))
    df = df.withColumn("_words", words(text)).drop("t")
    all_ = F.transform("_words", lambda w, i: join(_window(w, i, n)))
    whole = F.when(F.size("_words") >= n, F.slice(all_, F.lit(1), F.size("_words") - (n - 1)))
    name = "hash" if hashed else "shingle"
    return df.withColumn("_all", whole).drop("_words").withColumn(name, F.explode_outer("_all")).drop("_all").where(F.col(name).isNotNull())


def item_shingles(items: DataFrame, item_col="item_id", text_col="text", n=5) -> DataFrame:
    """Distinct (item_id, shingle, hash) with the item's number of shingles."""
    rows = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), F.col(text_col).alias("t"))
    rows = _shingles(rows, F.col("t"), n, hashed=False).distinct()
    hashed = rows.withColumn("hash", F.xxhash64(*[F.split("shingle", " ")[j] for j in range(n)]))
    return hashed.join(hashed.groupBy("item_id").agg(F.count("*").alias("n_shingles")), "item_id")


def item_sketches(shingles: DataFrame, threshold: float) -> DataFrame:
    """(hash, item_id, weight, need): weight is the number of hash functions that chose the shingle."""
    size, m, need = F.col("n_shingles"), F.lit(None).cast("int"), F.lit(None).cast("int")
    for most, functions, hits in reversed(SIZE_CLASSES):
        fits = F.lit(True) if most is None else size <= most
        m, need = F.when(fits, functions).otherwise(m), F.when(fits, hits).otherwise(need)
    need = F.coalesce((need * threshold / 0.8).cast("int"), F.ceil(size * threshold - 1e-9).cast("int"))
    rows = shingles.withColumn("m", m).withColumn("need", need)
    whole = rows.where("m is null").select("hash", "item_id", F.lit(1).alias("weight"), "need")
    drawn = (
        rows.where("m is not null").withColumn("j", F.explode(F.sequence(F.lit(1), F.col("m"))))
        .groupBy("item_id", "need", "j").agg(F.min_by("hash", F.xxhash64("hash", "j")).alias("hash"))
        .groupBy("hash", "item_id", "need").agg(F.count("*").cast("int").alias("weight"))
    )
    return whole.unionByName(drawn)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` only if it has few rows and bytes; otherwise Spark shuffles both sides."""
    texts = [F.octet_length(f.name) for f in df.schema.fields if f.dataType.simpleString() == "string"]
    size = F.coalesce(F.sum(sum(texts, F.lit(0).cast("long"))), F.lit(0))
    n, held = df.limit(rows + 1).agg(F.count("*"), size).first()
    return F.broadcast(df) if n <= rows and held <= BROADCAST_BYTES else df


def contained_items(
    documents: DataFrame, items: DataFrame, doc_col="doc_id", item_col="item_id", text_col="text",
    n=5, threshold=0.8, broadcast_rows=BROADCAST_ROWS,
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of pairs at or above ``threshold``."""
    shingles = staged(item_shingles(items, item_col, text_col, n), "item-shingles")
    sketches = _small(staged(item_sketches(shingles, threshold), "item-sketches"), broadcast_rows)
    texts = documents.where(F.col(doc_col).isNotNull()).select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("t"))
    probes = _shingles(texts, F.col("t"), n, hashed=True)
    # shingles that repeat in a document count once
    hits = probes.join(sketches, "hash").groupBy("doc_id", "item_id", "hash", "need").agg(F.first("weight").alias("weight"))
    candidates = hits.groupBy("doc_id", "item_id", "need").agg(F.sum("weight").alias("hits")).where("hits >= need")
    candidates = staged(candidates.select("doc_id", "item_id"), "candidates")

    few = _small(candidates.select("doc_id").distinct(), broadcast_rows)
    found = _shingles(texts.join(few, "doc_id", "left_semi"), F.col("t"), n, hashed=False)
    small = _small(shingles.select("item_id", "shingle", "n_shingles"), broadcast_rows)
    shared = (
        found.join(small, "shingle").groupBy("doc_id", "item_id", "n_shingles")
        .agg(F.countDistinct("shingle").alias("n_shared"))
        .where(F.col("n_shared") >= F.col("n_shingles") * threshold - 1e-9)
    )
    pairs = shared.join(candidates, ["doc_id", "item_id"], "left_semi")
    return pairs.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def decontaminate(documents: DataFrame, items: DataFrame, doc_col="doc_id", **options) -> DataFrame:
    """``documents`` without those that contain a test item; rows without an id stay."""
    leaks = staged(contained_items(documents, items, doc_col, **options).select(F.col("doc_id").alias(doc_col)).distinct(), "leaks")
    return documents.join(_small(leaks, BROADCAST_ROWS), doc_col, "left_anti")
