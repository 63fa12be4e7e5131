"""Helpers that the text operators share: reading, folds, bounded samples, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What separates words in every operator of this package: space and U+0009 to U+000D.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
_RATE = 1_000_000
#: Rows and bytes of one Arrow batch, so that a batch of very long texts still fits in a worker's memory.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo `folds`; null ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def label_of(labels: DataFrame, name: str) -> DataFrame:
    """One row per labelled document: repeated labels count once, the larger value wins."""
    return labels.where(F.col(name).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(name).alias("label"))


def bounded_sample(rows: DataFrame, group: str, size: int, key: str = "doc_id") -> DataFrame:
    """About `size` rows of each value of `group`, picked by a hash of `key`; all rows of smaller groups.

    The expected size is the bound: it doesn't grow with the input. `group` must have few values.
    """
    counts = rows.where(F.col(group).isNotNull()).groupBy(group).count().collect()
    if not counts:
        return rows.limit(0)
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r[0], min(1.0, size / r[1]) * _RATE)])
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(_RATE)) < rate[F.col(group)])


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds of what Spark hands to a Python worker at once, in rows and in bytes, to ours."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def map_batches(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow in batches of at most BATCH_ROWS rows, closed after the row that passes BATCH_BYTES, so that a worker's memory follows single texts."""
    small_batches(rows.sparkSession)
    return rows.mapInArrow(work, schema)


def keep_rows(rows: DataFrame, keep: Callable[[list[str | None]], list[bool]] , text: str = "text") -> DataFrame:
    """The rows whose text `keep` approves, with all their columns unchanged."""

    def work(batches):
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(batch.schema.get_field_index(text)).to_pylist()), pa.bool_()))

    return map_batches(rows, work, rows.schema)


def checkpointed(rows: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the cluster's shared checkpoint folder (a local one of our own only where none is set)."""
    sc = rows.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        given = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(given or "spark-warehouse/checkpoints")
    return rows.checkpoint(eager=True)
