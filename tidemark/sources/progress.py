"""Progress kept in files between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import monitor


def dump(progress: DataFrame, path: str) -> None:
    """Writes progress as one more version beside those that are there; a version counts once it is whole."""
    progress.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def load(spark: SparkSession, path: str, dbid: int | None = None) -> DataFrame:
    """All versions merged by key, as records that arrive late are; only those of one database if it is named.

    The order of writing breaks ties: of equal commit times the first version counts.
    """
    records = spark.read.parquet(path)
    if dbid is not None:
        records = records.where(F.col("dbid") == dbid)
    return monitor.progress(records.withColumn("arrival", F.unix_micros("written_at")))
