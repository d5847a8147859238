"""Fingerprints of documents by a homomorphic multiset hash of their paragraphs, in DataFrame code.

A paragraph (what stands between line breaks) hashes to a wide vector, and a document's fingerprint
is the sum of its paragraphs' vectors. So the order of paragraphs does not matter, and inserting or
deleting one is adding or subtracting its vector (:func:`plus`, :func:`minus`): nothing else of the
document has to be read again. The vector has two parts:

* ``LANES`` lanes modulo 2**32, hashed from the paragraph's SHA-256: two documents agree in all of
  them only if their paragraphs do.
* ``SIGNS`` lanes modulo 2**16, the sums of a random sign for each sentence of the paragraph. The
  squared difference of two such sums is on average the number of sentences in one document but
  not in the other, so :func:`likeness` can tell from two fingerprints alone how much of their
  documents is common: 1 - difference / (both sizes), with a standard error of about
  sqrt(2 / SIGNS) times the share that differs.

For speed :func:`vectors` sums in codegen, with two sign lanes packed into a long, so a document
may have 2**31 sentences. Rows that are dealt out by a column which is among ``keys`` are not
shuffled for it.

Defined cases: null and empty texts are one empty paragraph, without a sentence; white space within a
paragraph counts; equal texts have equal fingerprints, texts with the same paragraphs in another order too;
documents without a sentence are alike if their fingerprints are equal, else not at all; an empty table stays empty.
:func:`edited_fingerprints` orders rows by id, null last, then by a hash of the text; of rows that
share an id and a text each is followed by its copy; it returns columns of its own only, so other
columns' names cannot clash. Ids are numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LANES, SIGNS = 16, 128
_SENTENCE = r"\n|(?<=[.!?])\s"
#: Buckets whose bounds are compared before those within one are.
_STEP = 64


def _vector(sums: list[Column], bits: list[Column], n: Column) -> Column:
    """The lanes of a fingerprint as one array, from sums of lanes and counts of packed sign bits."""
    lanes = [s.bitwiseAND(0xFFFFFFFF) for s in sums]
    packed = F.array(*bits)
    low = F.transform(packed, lambda x: F.pmod(2 * x.bitwiseAND(0x7FFFFFFF) - n + 32768, F.lit(65536)) - 32768)
    high = F.transform(packed, lambda x: F.pmod(2 * F.shiftright(x, 31) - n + 32768, F.lit(65536)) - 32768)
    return F.concat(F.array(*lanes), low, high)


def vectors(df: DataFrame, keys: list[str], texts: dict[int, str]) -> DataFrame:
    """(keys, ``side``, ``vector``): the fingerprint of each text column, a side being its number in ``texts``.

    ``keys`` must tell all rows apart. A null text gives no row; coalesce it to be an empty document.
    """
    sides = sorted(texts)
    parts = [F.split(texts[s], p) for s in sides for p in ("\n", _SENTENCE)]
    split = df.select(*keys, F.posexplode(F.array(*parts)).alias("_kind", "_parts"))
    rows = split.select(*keys, "_kind", F.explode("_parts").alias("_part"))
    whole = F.col("_kind") % 2 == 0
    told = F.when(~whole & (F.col("_part") != ""), F.col("_part"))
    rows = rows.select(
        *keys, F.element_at(F.array(*[F.lit(s) for s in sides]), F.floor(F.col("_kind") / 2).cast("int") + 1).alias("side"),
        F.when(whole, F.sha2("_part", 256)).alias("_hash"), *[F.when(told.isNotNull(), F.xxhash64(told, F.lit(i))).alias(f"_s{i}") for i in (0, 1)],
    )
    lanes = [F.sum(F.when(F.col("_hash").isNotNull(), F.xxhash64("_hash", F.lit(i)).bitwiseAND(0xFFFFFFFF))).alias(f"_l{i}") for i in range(LANES)]

    def bit(word: str, k: int) -> Column:
        return F.shiftrightunsigned(word, k).bitwiseAND(1)

    signs = [F.sum(bit("_s0", k) + bit("_s1", k) * (1 << 31)).alias(f"_b{k}") for k in range(SIGNS // 2)]
    sums = rows.groupBy(*keys, "side").agg(*lanes, *signs, F.count("_s0").alias("_n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    vector = _vector([zero(f"_l{i}") for i in range(LANES)], [zero(f"_b{k}") for k in range(SIGNS // 2)], F.col("_n"))
    return sums.select(*keys, "side", vector.alias("vector"))


def _combined(a: Column, b: Column, sign: int) -> Column:
    lanes = F.zip_with(F.slice(a, 1, LANES), F.slice(b, 1, LANES), lambda x, y: (x + sign * y).bitwiseAND(0xFFFFFFFF))
    signs = F.zip_with(F.slice(a, LANES + 1, SIGNS), F.slice(b, LANES + 1, SIGNS), lambda x, y: F.pmod(x + sign * y + 32768, F.lit(65536)) - 32768)
    return F.concat(lanes, signs)


def plus(a: Column, b: Column) -> Column:
    """The fingerprint of all paragraphs of both."""
    return _combined(a, b, 1)


def minus(a: Column, b: Column) -> Column:
    """The fingerprint of ``a`` without the paragraphs of ``b``, which it has."""
    return _combined(a, b, -1)


def as_string(vector: Column) -> Column:
    """All lanes in hexadecimal digits: 8 for each of the first, 4 for each sign lane."""
    lanes = F.transform(F.slice(vector, 1, LANES), lambda x: F.lpad(F.hex(x), 8, "0"))
    signs = F.transform(F.slice(vector, LANES + 1, SIGNS), lambda x: F.lpad(F.hex(x.bitwiseAND(0xFFFF)), 4, "0"))
    return F.lower(F.concat(F.array_join(lanes, ""), F.array_join(signs, "")))


def likeness(a: Column, b: Column) -> Column:
    """How much of two documents is common, from 0 to 1, by their fingerprints."""
    x, y = F.slice(a, LANES + 1, SIGNS), F.slice(b, LANES + 1, SIGNS)
    wrapped = lambda d: F.pmod(d + 32768, F.lit(65536)) - 32768
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    apart, sizes = total(F.zip_with(x, y, lambda p, q: wrapped(p - q))), total(x) + total(y)
    return F.when(a == b, 1.0).when(sizes == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - apart / sizes))


def _order_key(id_col: str, text_col: str) -> Column:
    """A string that sorts as descending id, null last, then hash of the text."""
    backwards = F.lpad(F.hex(F.col(id_col).cast("long").bitwiseXOR((1 << 63) - 1)), 16, "0")
    return F.concat(F.coalesce(F.concat(F.lit("0"), backwards), F.lit("1")), F.lpad(F.hex(F.xxhash64(text_col)), 16, "0"))


def _bucket(key: Column, bounds: list[str]) -> Column:
    """The number of the last bound that is not above ``key``, from 0."""
    passed = lambda some: F.size(F.filter(some, lambda b: b <= key))
    if len(bounds) <= _STEP:
        return passed(F.lit(bounds)) - 1
    step = passed(F.lit(bounds[::_STEP])) - 1
    return step * _STEP + passed(F.slice(F.lit(bounds), step * _STEP + 1, _STEP)) - 1


def with_next(df: DataFrame, id_col="doc_id", text_col="text", buckets: int | None = None) -> DataFrame:
    """(bucket, guest, key, copy, times, id, text, next_text): rows in buckets of neighbours, by descending id.

    The first row of each bucket also stands in the one before, as its last and a ``guest`` there, so a row's
    successor is always at hand; that of the last row is the first. Texts are shuffled once. ``times``
    says how many rows a row stands for.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", _order_key("id", "text"))
    n = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    keys = rows.groupBy("key").agg(F.count("*").alias("n"))
    cut = keys.repartitionByRange(n, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("first"), F.max("n").alias("most"))
    found = cut.collect()  # a row for each bucket
    bounds = sorted(r["first"] for r in found) or [""]
    if max((r["most"] for r in found), default=1) > 1:  # rows that share id and text meet once, combined in their tasks
        rows = rows.groupBy("key", "id").agg(F.first("text").alias("text"), F.count("*").alias("n"))
        stands = F.when(F.col("n") > 1, F.array(F.col("n") - 1, F.lit(1).cast("long"))).otherwise(F.array(F.lit(1).cast("long")))
        rows = rows.select("key", "id", "text", F.posexplode(stands).alias("copy", "times"))
    else:
        rows = rows.select("key", "id", "text", F.lit(0).alias("copy"), F.lit(1).cast("long").alias("times"))
    rows = rows.withColumn("b", _bucket(F.col("key"), bounds))
    leads = (F.element_at(F.lit(bounds), F.col("b") + 1) == F.col("key")) & (F.col("copy") == 0)
    place = lambda b, guest: F.struct(b.alias("bucket"), F.lit(guest).alias("guest"))
    own, before = place(F.col("b"), False), place(F.pmod(F.col("b") - 1, F.lit(len(bounds))), True)
    rows = rows.select("key", "copy", "times", "id", "text", F.inline(F.when(leads, F.array(own, before)).otherwise(F.array(own))))
    order = W.partitionBy("bucket").orderBy("guest", "key", "copy")
    return rows.repartitionById(len(bounds), F.col("bucket")).withColumn("next_text", F.lead("text").over(order))


def edited_fingerprints(df: DataFrame, id_col="doc_id", text_col="text", buckets: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness.

    The edited text has the last half of the code points (rounded down) replaced by as many of the
    first ones of the next document, by descending id, or all of them.
    """
    rows = with_next(df, id_col, text_col, buckets)
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - half), F.substring("next_text", F.lit(1), half))
    keys = ["bucket", "guest", "key", "copy"]
    # a guest's edited text is null and gives no parts
    rows = rows.select(*keys, "times", "id", "text", F.when(~F.col("guest"), edited).alias("edited"))
    rows = rows.select(*keys, "times", "id", "text", "edited", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("sha"))
    found = vectors(rows, [*keys, "times", "id", "n_chars", "sha"], {0: "text", 1: "edited"})
    order = W.partitionBy("bucket").orderBy("guest", "key", "copy", "side")
    found = found.withColumns({"edited_vector": F.lead("vector", 1).over(order), "next_vector": F.lead("vector", 2).over(order)})
    found = found.where((F.col("side") == 0) & ~F.col("guest"))
    own, other, after = F.col("vector"), F.col("edited_vector"), F.col("next_vector")
    found = found.select(
        F.col("id").alias(id_col), "n_chars", F.col("sha").alias("edited_sha256"), as_string(own).alias("fingerprint"),
        as_string(other).alias("edited_fingerprint"), likeness(own, other).alias("near_edited"), likeness(own, after).alias("near_next"), "times",
    )
    names = [c for c in found.columns if c != "times"]
    return found.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("_time")).drop("_time")
