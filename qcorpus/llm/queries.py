"""The registered queries of the text operators, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, dialogue, hilbert, infill, langcnn, linebreaks, multiset, packing, recompress, repetition, simhash, toxcrf, warc
from .common import forget, new_path, staged, table


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = repetition.repetition(repetition.with_line_counts(docs).select("doc_id", "text", "n_symbols", "n_dup_lines"), keep_text=False)
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & ~F.col("repetitive")).alias("kept"),
    )


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linebreaks.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_shared", "containment")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return recompress.remove_repeats(docs, keep_text=False)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = staged(packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer_path()), "pieces")
    return packing.pack(pieces)


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        hilbert.quantiles(docs, "lang").alias("lang_cell"), hilbert.quantiles(docs, "source").alias("source_cell"),
        hilbert.level(F.octet_length(text)).alias("size_cell"),
    )
    cells = ["lang_cell", "source_cell", "size_cell"]
    cut = hilbert.hilbert_shards(rows, [F.col(c) for c in cells], order=["doc_id", "text_crc32", "size"])
    return cut.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve_index", "lang", "source", *cells,
    )


def held_out() -> Column:
    """Documents that no model learns from; those without an id are never learned from either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op8_language_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langcnn.fit(docs.where(~held_out()), key=F.xxhash64("doc_id"))
    found = langcnn.identify(docs.select("doc_id", "text"), net, keep_text=False)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op9_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out())
    drawn = F.broadcast(toxcrf.draw_labels(labels))  # at most 4,000 rows
    field = toxcrf.fit(docs.join(drawn, "doc_id"), key=F.xxhash64("doc_id"), shares=toxcrf.label_counts(labels))
    found = toxcrf.score(docs, field, keep_text=False)
    return found.select(
        "doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), "toxic_spans",
    )


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    forget(spark, path)
    return warc.resolve_revisits(warc.read_archives(spark, path, payloads=False))


def op11_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.edited_fingerprints(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return dialogue.repair(dialogue.damaged(rows), rows)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infill.infill(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    found = found.withColumn("output_sha256", F.sha2("infill_text", 256))
    return infill.restore(found, keep_out=False).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2("restored_text", 256).alias("restored_sha256")
    )


QUERIES = {
    "op1_repetition": op1_repetition,
    "op2_main_text": op2_main_text,
    "op3_decontamination": op3_decontamination,
    "op4_simhash": op4_simhash,
    "op5_recompression": op5_recompression,
    "op6_sum_of_squares_packing": op6_sum_of_squares_packing,
    "op7_hilbert_shards": op7_hilbert_shards,
    "op8_language_cnn": op8_language_cnn,
    "op9_toxicity_crf": op9_toxicity_crf,
    "op10_warc_revisits": op10_warc_revisits,
    "op11_multiset_hash": op11_multiset_hash,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL = {
    "op1_repetition": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM d
), word AS (SELECT doc_id, unnest(w) AS a, unnest(range(len(w))) AS i FROM d
), win AS (
  SELECT doc_id, i, a,
    CASE WHEN count(*) OVER s = 8 THEN list(a) OVER s END AS short,
    CASE WHEN count(*) OVER l = 101 THEN md5(array_to_string(list(a) OVER l, ' ')) END AS long
  FROM word WINDOW s AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING),
    l AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 100 FOLLOWING)
), twice AS (
  SELECT doc_id, i, a, short IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, short) > 1 AS again,
    long IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, long) > 1 AS long_again
  FROM win
), inside AS (
  SELECT doc_id, a, long_again, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM twice
), repeats AS (
  SELECT doc_id, count(*) FILTER (hit) AS n, coalesce(sum(length(a)) FILTER (hit), 0) AS chars, bool_or(long_again) AS too_long
  FROM inside GROUP BY doc_id
), r AS (
  SELECT base.doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(chars, 0) AS chars, coalesce(too_long, false) AS too_long
  FROM base LEFT JOIN repeats USING (doc_id)
), f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (chars > 0.2 * word_chars OR too_long) AS kept
FROM f
""",
    "op3_decontamination": """
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w
  FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w
  FROM benchmark
), dw AS (SELECT doc_id, unnest(w) AS a, unnest(range(len(w))) AS i FROM d
), bw AS (SELECT item_id, unnest(w) AS a, unnest(range(len(w))) AS i FROM b
), dl AS (
  SELECT doc_id, a || ' ' || lead(a, 1) OVER t || ' ' || lead(a, 2) OVER t || ' ' || lead(a, 3) OVER t || ' ' || lead(a, 4) OVER t AS s
  FROM dw WINDOW t AS (PARTITION BY doc_id ORDER BY i)
), bl AS (
  SELECT item_id, a || ' ' || lead(a, 1) OVER t || ' ' || lead(a, 2) OVER t || ' ' || lead(a, 3) OVER t || ' ' || lead(a, 4) OVER t AS s
  FROM bw WINDOW t AS (PARTITION BY item_id ORDER BY i)
), bs AS (SELECT DISTINCT item_id, s FROM bl WHERE s IS NOT NULL
), ds AS (SELECT DISTINCT doc_id, s FROM dl WHERE s IN (SELECT s FROM bs)
), q AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, count(*) / n_shingles::DOUBLE AS containment
FROM ds JOIN bs USING (s) JOIN q USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= 0.8 * n_shingles - 1e-9
""",
}
