"""Structured Streaming forms of the append-style operators: an extension, batch is the norm.

The functions take and return streaming DataFrames; the caller names source, sink and checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_counts(events: DataFrame, at: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and key; a window is final once events that late would be dropped."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    counts = timed.groupBy(F.window("_at", window), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), key, "n")


def new_artifacts(artifacts: DataFrame, content: str, at: str, late: str = "1 day") -> DataFrame:
    """Artifacts with a content hash that none within the watermark had."""
    hashed = artifacts.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256)).withWatermark(at, late)
    return hashed.dropDuplicatesWithinWatermark(["sha256"])


def upsert_into(target_path: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each batch into versions below ``target_path``.

    A batch that is delivered again writes the same version, so the merge happens once.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        source = spark.read.schema(batch.schema).parquet(f"{target_path}/v={number - 1}") if number else batch.limit(0)
        merge(source, batch).write.mode("overwrite").parquet(f"{target_path}/v={number}")

    return write
