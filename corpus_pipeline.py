"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's documents. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qcorpus.llm import decontam, langcnn, packing, recompress, simhash
from qcorpus.llm.common import drop_path, scratch, staged, stored, table
from qcorpus.llm.queries import held_out, tokenizer_path

#: A text whose best language gets less than this is rejected, as one without a letter is.
LEAST_LANGUAGE_SCORE = 0.5


#: Columns that stages read; all others travel in one, so that no name clashes with what an operator adds.
_READ = ("doc_id", "text", "lang", "n_chars")


def _held(docs: DataFrame) -> DataFrame:
    rest = [F.col(c) for c in docs.columns if c not in _READ]
    return docs.select(*[c for c in docs.columns if c in _READ], (F.struct(*rest) if rest else F.lit(0)).alias("_rest"))


def _released(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select([F.col(c) if c in _READ else F.col("_rest")[c].alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network has learned."""
    net = langcnn.fit(docs.where(~held_out()), key=F.xxhash64("doc_id"))
    found = langcnn.identify(_held(docs), net)
    return _released(found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE)), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of linked fingerprints."""
    return simhash.deduplicate(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that start earlier in the corpus; those with no word left go."""
    found = recompress.remove_repeats(_held(docs))
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    kept = found.where("n_words > n_removed")
    return _released(kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, size).otherwise(F.col("n_chars"))), docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of at most 4096 tokens."""
    return packing.pack(staged(packing.token_pieces(docs, tokenizer_path()), "pieces"))


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the network nor the packing rule; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark):  # what the stage has stored on its way goes when its result is written
            found = stage(spark, docs, sf_dir)
            with scratch(spark, keep=True):
                docs, path = stored(found, name)
        if before:
            drop_path(spark, before)
        before = path
    return docs
