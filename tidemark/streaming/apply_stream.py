"""A change stream applied to a table kept as Parquet, batch by batch.

Each batch reads the newest version of the table, folds its changes and writes the next version beside it, named after
the batch. A version counts once it is whole (its _SUCCESS file is there), so a batch that is run again after a failure
starts from the version before its own and writes the same rows: every change counts once. Positions are the order; rows
of one key in one batch are folded in that order, and batches must come in order, as files of one directory do.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import apply


class Versions:
    """The versions of a table under a folder that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self.path = spark, path

    def _list(self) -> list[int]:
        jvm = self._spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self._spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def before(self, batch: int) -> DataFrame | None:
        found = [v for v in self._list() if v <= batch]
        return self._spark.read.parquet(f"{self.path}/v{found[-1]}") if found else None

    def newest(self) -> DataFrame | None:
        found = self._list()
        return self._spark.read.parquet(f"{self.path}/v{found[-1]}") if found else None

    def write(self, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/v{version}")


def apply_stream(
    changes: DataFrame,
    initial: DataFrame,
    path: str,
    checkpoint: str,
    key: Sequence[str],
    columns: Sequence[str],
    deltas: Sequence[str] = (),
    own_tiebreaker: int = 1,
    tiebreakers: Mapping[int, int] | None = None,
    log_path: str | None = None,
) -> StreamingQuery:
    """Starts a query over all files that are there; await it. `log_path` gets a folder a batch with what happened to each change."""
    spark = initial.sparkSession
    versions = Versions(spark, path)

    def one(batch: DataFrame, number: int) -> None:
        before = versions.before(number)
        state = initial if before is None else before
        batch = batch.persist()
        try:
            table, log = apply.applied(batch, state, key, columns, deltas, own_tiebreaker, tiebreakers)
            versions.write(table, number + 1)
            if log_path:
                log.write.mode("overwrite").parquet(f"{log_path}/batch={number}")
        finally:
            batch.unpersist()

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(changes: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Changes by window of commit time and operation, with a watermark that bounds the state."""
    from pyspark.sql import functions as F

    return changes.withWatermark("commit_ts", late).groupBy(F.window("commit_ts", width), "op").agg(F.count("*").alias("n")).select("window.start", "op", "n")
