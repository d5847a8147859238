"""Definition files of sources: a folder of settings as rows, read by Spark, wherever the folder is."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.settings import SettingsError, read_settings


@F.pandas_udf(T.StructType([T.StructField("document", T.StringType()), T.StructField("error", T.StringType())]))
def _read(contents: pd.Series) -> pd.DataFrame:
    def one(text: str | None) -> tuple[str | None, str | None]:
        try:
            return json.dumps(read_settings(text or ""), ensure_ascii=False, sort_keys=True), None
        except SettingsError as e:
            return None, str(e)

    return pd.DataFrame([one(t) for t in contents], columns=["document", "error"])


def definition_files(spark: SparkSession, folder: str, pattern: str = "source.yaml") -> DataFrame:
    """(path, document, error): each file below ``folder`` whose name fits, as JSON; what cannot be read has its error. An empty file gives no row."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), "value").select("path", _read("value").alias("r")).select("path", "r.*")


def definitions(files: DataFrame, schema: str) -> DataFrame:
    """The rows of definition files: a file's own map, or each of the maps under its key ``sources``; fields as in ``schema``."""
    many = F.from_json("document", f"sources array<struct<{schema}>>")["sources"]
    one = F.from_json("document", f"struct<{schema}>")
    return files.where("document is not null").select(F.inline(F.coalesce(many, F.array(one))))
