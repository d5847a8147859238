"""Tables that jobs write on their way, and kept tables of postings, in folders that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a local session gets a temporary one."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-qcorpus-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return f"file://{_own_dirs[app]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


#: Spark's setting by which a query's shuffle files go when it ends, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is written within the block go with its end; the table has the result."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` from a Parquet table in the shared folder, which goes when the application ends.

    What follows survives lost executors without redoing what led here.
    """
    return stored_parts([df], name)


def stored_parts(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """As :func:`stored`, of one or more tables of one schema that are worked out and written one after another."""
    path = None
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        path = path or new_path(spark, name)
        with shuffles_released(spark):
            df.write.mode("append").parquet(path)
    system, where = folder(spark, path)
    system.deleteOnExit(where)
    return spark.read.schema(schema).parquet(path)


@dataclass
class Postings:
    """Rows by a key in a bucketed, sorted Parquet table at ``path``, to which rows can be added.

    A join on the key shuffles only its other side, and a lookup of a few keys reads their buckets and row groups.
    The table is known to the session as ``name``; a later session finds it again by its path.
    """

    spark: SparkSession
    path: str
    name: str
    key: str
    buckets: int

    def add(self, rows: DataFrame, segment: str | None = None) -> None:
        """Append rows, a file for each bucket, of each ``segment`` if they are dealt out by that column too."""
        bucket = F.pmod(F.hash(self.key), F.lit(self.buckets))  # as Spark deals rows to buckets
        dealt = rows.repartition(bucket, *([segment] if segment else []))
        writer = dealt.write.bucketBy(self.buckets, self.key).sortBy(self.key).format("parquet").option("path", self.path).mode("append")
        (writer.partitionBy(segment) if segment else writer).saveAsTable(self.name)

    def open(self, schema: str, segment: str | None = None) -> None:
        """Make the table known that an earlier session has left at the path."""
        parts = f"PARTITIONED BY ({segment}) " if segment else ""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({schema}) USING parquet {parts}CLUSTERED BY ({self.key}) SORTED BY ({self.key}) "
            f"INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        if segment:
            self.spark.catalog.recoverPartitions(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def lookup(self, keys: list) -> DataFrame:
        """The rows of a few keys."""
        return self.table().where(F.col(self.key).isin(keys))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        system, where = folder(self.spark, self.path)
        system.delete(where, True)

    def drop_at_end(self) -> None:
        system, where = folder(self.spark, self.path)
        system.deleteOnExit(where)
