"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import folder, new_path, shared_dir, shuffles_released  # noqa: F401  for the operators and tests

#: Folders written within the open ``scratch`` blocks, innermost last.
_written: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has written."""
    system, where = folder(spark, path)
    system.delete(where, True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a Parquet table in the shared folder and read it back; also where it is."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_released(spark):
        df.write.parquet(path)
    forget(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder that has been written with the ``scratch`` block it was made in, or when the application ends."""
    system, where = folder(spark, path)
    system.deleteOnExit(where)
    if _written:
        _written[-1].append(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` from a table in the shared folder.

    This cuts the lineage: what follows survives lost executors without redoing what led here. The
    table goes when the application ends, or before with the ``scratch`` block that it is made in.
    """
    return stored(df, name)[0]


@contextmanager
def scratch(spark: SparkSession, keep: bool = False) -> Iterator[None]:
    """Delete what is stored within the block at its end, unless it is to ``keep``; results must have been written."""
    _written.append([])
    try:
        yield
    finally:
        for path in _written.pop():
            if not keep:
                drop_path(spark, path)


def byte_slices(
    batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 8 << 20
) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``max_bytes`` in each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0)
        sizes = np.asarray(lengths.to_numpy(zero_copy_only=False), np.int64)
        part = np.cumsum(sizes + 1) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; none for null."""
    return [x.as_py() or b"" for x in column.cast(pa.binary())]


def with_added(df: DataFrame, text_col: str, keep_text: bool, added: str) -> tuple[DataFrame, list[str], str]:
    """``df`` without columns named as ``added`` ones, the columns that stay, and the schema of both.

    The text goes to Python once, and back only if it stays.
    """
    names = {x.split()[0] for x in added.split(", ")} - {text_col}
    rows = df.drop(*names)
    stay = [f for f in rows.schema.fields if keep_text or f.name != text_col]
    return rows, [f.name for f in stay], ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in stay), added])


def draw(rows: DataFrame, label: str, key: str, most: int, most_labels: int = 256, most_rows: int = 60_000) -> DataFrame:
    """At most ``most`` rows of each label, those whose key hashes lowest, as a sample to train on.

    Only the ``most_labels`` labels with the most rows are learned, and of many labels so few rows each that
    all have ``most_rows`` together, so that a column full of odd values stays bounded too. A cut by the label's own count leaves about four times as many before rows are
    ranked, so what is shuffled is bounded by the labels, not by the partitions.
    """
    counts = rows.groupBy(label).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), label).limit(most_labels)
    most = max(1, min(most, most_rows // max(1, counts.count())))
    lucky = F.pmod(F.xxhash64(key, F.lit(2)), F.lit(1_000_000)) * F.col("_n") < F.lit(4_000_000 * most)
    number = F.row_number().over(W.partitionBy(label).orderBy(F.xxhash64(key), key))
    some = rows.join(F.broadcast(counts), label).where(lucky).drop("_n")
    return some.withColumn("_n", number).where(F.col("_n") <= most).drop("_n")
