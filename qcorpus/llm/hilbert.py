"""Shards cut from a Hilbert-curve order of several metadata dimensions.

Each dimension is quantised to a few bits in its own order, so that a run of the curve is a box or
two of value ranges, and a filter on a dimension leaves out the shards whose range it misses. Sizes
take a logarithmic scale, other values the quantiles of the column. The curve index of the cell is
computed in Arrow batches, and rows are ranked along the curve. The rank needs no global sort: equal
rows are counted first, rows are counted by cell and by a salted sub-bucket of the cell, the counts
are summed up (over the cells, whose number the bits bound, in one small window; over the
sub-buckets within their cell), and rows are numbered within a sub-bucket. A cell that holds a third
of all rows is so spread over many sub-buckets of about ``bucket_rows`` rows, and copies of a row
are made again in parts of as many.

Defined cases: a null text has no bytes; null dimensions take the first cell; repeated rows and
equal keys take neighbouring slots; an empty table gives an empty result; a caller's
``curve_index``, ``shard`` and ``slot`` are replaced, all other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import staged

BITS = 4


def hilbert_index(coordinates: np.ndarray, bits: int) -> np.ndarray:
    """Curve indexes of the integer points in the rows of ``coordinates`` (Skilling, 2004)."""
    x = np.array(coordinates, np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(flip, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    index = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def curve(dimensions: list[Column], bits: int = BITS) -> Column:
    @F.pandas_udf("long")
    def index(points: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(points.to_numpy(), bits))

    return index(F.struct(*[d.cast("int").alias(f"d{i}") for i, d in enumerate(dimensions)]))


def level(value: Column, bits: int = BITS) -> Column:
    """A size on a logarithmic scale, from 0 to 2**bits - 1."""
    return F.least(F.floor(F.log2(F.coalesce(value, F.lit(0)) + 1) * ((1 << bits) / 24)), F.lit((1 << bits) - 1)).cast("int")


def quantiles(df: DataFrame, column: str, bits: int = BITS) -> Column:
    """The quantile of a column's value, from 0 to 2**bits - 1; null is in the first.

    It is the number of rows with a smaller value, times 2**bits, by the number of all rows with a value.
    All distinct values are counted, put in order by ranges and summed up there; only the smallest value
    of each quantile comes to the driver.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    values = staged(counts.repartitionByRange("value").withColumn("range", F.spark_partition_id()), "values")
    # one row for each range
    ranges = values.groupBy("range").agg(F.sum("n").alias("size"))
    ranges = ranges.select(
        "range", (F.sum("size").over(W.orderBy("range")) - F.col("size")).alias("start"), F.sum("size").over(W.partitionBy()).alias("total")
    )
    within = F.sum("n").over(W.partitionBy("range").orderBy("value")) - F.col("n")
    cells = values.withColumn("within", within).join(ranges, "range")
    cells = cells.select("value", F.expr(f"cast((start + within) * {1 << bits} div total as int)").alias("cell"))
    found = F.lit(0)
    for row in sorted(cells.groupBy("cell").agg(F.min("value").alias("least")).collect(), key=lambda r: r["cell"]):
        found = F.when(F.col(column) >= F.lit(row["least"]), row["cell"]).otherwise(found)
    return found


def hilbert_shards(df: DataFrame, dimensions: list[Column], order: list[str], shards: int = 8, bits: int = BITS, bucket_rows: int = 4096) -> DataFrame:
    """Add ``curve_index``, ``shard`` and ``slot``: runs of the curve with counts at most one apart.

    ``order`` breaks ties within a cell. Keep ``df`` narrow, as its rows are stored and shuffled.
    """
    names = [c for c in df.columns if c not in ("curve_index", "shard", "slot")]
    rows = df.withColumn("_curve", curve(dimensions, bits)).select(*names, "_curve")
    rows = staged(rows.groupBy(*names, "_curve").agg(F.count("*").alias("_copies")), "curve")
    # at most 2**(bits * dimensions) rows, whatever the input
    cells = rows.groupBy("_curve").agg(F.sum("_copies").alias("_cell"), F.max("_copies").alias("_most"))
    cells = staged(cells.withColumn("_cell_start", F.sum("_cell").over(W.orderBy("_curve")) - F.col("_cell")), "cells")
    total, most = cells.agg(F.sum("_cell"), F.max("_most")).first()
    total = total or 0
    salts = F.ceil(F.col("_cell") / bucket_rows)
    rows = rows.join(cells.drop("_most"), "_curve").withColumn("_salt", F.pmod(F.xxhash64(*order), salts).cast("int"))
    buckets = rows.groupBy("_curve", "_salt").agg(F.sum("_copies").alias("_n"))
    within = W.partitionBy("_curve").orderBy("_salt")
    starts = buckets.withColumn("_bucket_start", F.sum("_n").over(within) - F.col("_n")).drop("_n")
    before = F.sum("_copies").over(W.partitionBy("_curve", "_salt").orderBy(*order, *[c for c in names if c not in order])) - F.col("_copies")
    ranked = rows.withColumn("_before", before).join(starts, ["_curve", "_salt"]).withColumn(
        "_first", F.col("_cell_start") + F.col("_bucket_start") + F.col("_before")
    )
    if (most or 0) > 1:
        parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / bucket_rows))
        ranked = ranked.withColumn("_part", F.explode(parts))
        if most > bucket_rows:
            ranked = ranked.repartition("_curve", "_first", "_part")
        last = F.least(F.col("_copies"), (F.col("_part") + 1) * bucket_rows) - 1
        ranked = ranked.withColumn("_copy", F.explode(F.sequence(F.col("_part") * bucket_rows, last)))
        ranked = ranked.withColumn("_rank", F.col("_first") + F.col("_copy"))
    else:
        ranked = ranked.withColumnRenamed("_first", "_rank")
    shard = F.expr(f"cast(_rank * {shards} div {max(total, 1)} as int)")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("_rank") - first).select(
        *names, F.col("_curve").alias("curve_index"), "shard", "slot"
    )
