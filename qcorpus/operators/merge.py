"""Keyed writes as pure functions of target and source: run twice, they change nothing.

A merge is a full outer join on the key with a choice per column, so both sides are shuffled by the
key once. A key may be null: keys are compared null-safe where they are told to be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import stored


def _joined(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    old = target.select(*keys, F.struct(*[c for c in target.columns]).alias("old"))
    new = source.select(*keys, F.struct(*[c for c in source.columns]).alias("new"))
    return old.join(new, keys, "full_outer")


def merge_upsert(
    target: DataFrame, source: DataFrame, keys: list[str], update: list[str] | None = None,
    condition: Column | None = None, set_values: dict[str, Column] | None = None,
) -> DataFrame:
    """Insert new keys and update known ones.

    ``update`` names the columns that an update takes from the source (by default all but the keys);
    ``condition`` may refer to ``old.*`` and ``new.*`` and says which known rows change;
    ``set_values`` overrides single columns of updated rows by expressions over both.
    """
    update = [c for c in target.columns if c not in keys] if update is None else update
    set_values = set_values or {}
    known, given = F.col("old").isNotNull(), F.col("new").isNotNull()
    changes = known & given & (F.lit(True) if condition is None else F.coalesce(condition, F.lit(False)))
    columns = []
    for c in target.columns:
        if c in keys:
            columns.append(F.col(c))
            continue
        fresh = set_values[c] if c in set_values else F.col(f"new.{c}")
        inserted = F.col(f"new.{c}") if c in source.columns else F.lit(None).cast(target.schema[c].dataType)
        value = F.when(~known, inserted)
        if c in update or c in set_values:
            value = value.when(changes, fresh)
        columns.append(value.otherwise(F.col(f"old.{c}")).alias(c))
    return _joined(target, source, keys).select(*columns)


def insert_absent(target: DataFrame, source: DataFrame, keys: list[str], null_safe: bool = False) -> DataFrame:
    """Rows of ``source`` whose key the target lacks, one for each key, after those of the target."""
    fresh = source.dropDuplicates(keys)
    if null_safe:
        a, b = fresh.alias("a"), target.select(*keys).alias("b")
        on = F.lit(True)
        for k in keys:
            on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        fresh = a.join(b, on, "left_anti")
    else:
        fresh = fresh.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def ranked(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """Add the rank, from 1, of each row in its group by ``order``, which tells its rows apart.

    Rows are put in order by ranges over groups and order together, so a group of a third of all rows is not one task's: ranks
    within a range are added to the number of the group's rows in the ranges before.
    """
    keys = [*groups, *order]
    rows = stored(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = rows.groupBy(*groups, "_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy(*groups).orderBy("_range")) - F.col("_n")).drop("_n")
    own = F.row_number().over(W.partitionBy(*groups, "_range").orderBy(*order))
    same = F.col("_range") == F.col("_r")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    before = before.select(*[F.col(g).alias(f"_{g}") for g in groups], F.col("_range").alias("_r"), "_before")
    return rows.withColumn("_own", own).join(before, same).select(*df.columns, (F.col("_own") + F.col("_before")).alias(name))


def append_numbered(target: DataFrame, source: DataFrame, group: str, order: list[str], number: str) -> DataFrame:
    """Source rows with numbers that go on from each group's largest; given numbers stay."""
    top = target.groupBy(group).agg(F.max(number).alias("_top"))
    rows = ranked(source.withColumn("_open", F.col(number).isNull()), [group, "_open"], order, "_place").join(top, group, "left")
    return rows.withColumn(number, F.coalesce(F.col(number), F.coalesce(F.col("_top"), F.lit(0)) + F.col("_place"))).drop("_top", "_place", "_open")


def content_addressed(existing: DataFrame, incoming: DataFrame, content: str, key: str = "sha256") -> DataFrame:
    """Incoming blobs of which no blob with the same SHA-256 is stored, one for each hash."""
    hashed = incoming.withColumn(key, F.sha2(F.col(content).cast("binary"), 256))
    return hashed.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def missing_keys(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Keys of ``wanted`` that ``present`` lacks, once each."""
    return wanted.select(key).distinct().join(present.select(key), key, "left_anti")


def copy_missing(wanted: DataFrame, remote: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """Per key: already there, to be copied, or missing here too."""
    rows = wanted.select(key).distinct()
    rows = rows.join(remote.select(key, F.lit(True).alias("_remote")).distinct(), key, "left")
    rows = rows.join(local.select(key, F.lit(True).alias("_local")).distinct(), key, "left")
    return rows.select(key, F.when(F.col("_remote"), "present").when(F.col("_local"), "copy").otherwise("missing").alias("action"))


def prune(df: DataFrame, at: str, days: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that stay and those older than ``days`` days."""
    old = F.coalesce(F.col(at) < now - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))
    return df.where(~old), df.where(old)


def media_key(sha256: Column, mime: Column) -> Column:
    """Storage key of an image, ``hh/sha.ext``; null where the type is not allowed.

    Fixed values: the types and their endings.
    """
    ending = F.create_map(*[F.lit(x) for x in ("image/png", "png", "image/jpeg", "jpg", "image/gif", "gif", "image/webp", "webp", "image/svg+xml", "svg")])
    ext = F.try_element_at(ending, F.lower(mime))
    return F.concat(F.substring(sha256, 1, 2), F.lit("/"), sha256, F.lit("."), ext)
