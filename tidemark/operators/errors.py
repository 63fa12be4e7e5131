"""What becomes of transactions with a change that can't be applied.

`changes` has xid, commit_lsn, seq, failed (boolean) and error_message.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POLICIES = ("discard", "transdiscard", "sub_disable")


def _txn():
    return W.partitionBy("xid")


def failing(changes: DataFrame) -> DataFrame:
    """xid and first failing place of each transaction that fails; failures are few, and counted before they are shuffled."""
    return changes.where("failed").groupBy("xid").agg(F.min(F.struct("commit_lsn", "seq")).alias("_first"))


def applied(changes: DataFrame, policy: str = "transdiscard") -> DataFrame:
    """The changes that take effect: without the failed ones, without their transactions, or only what comes before the first failure.

    No transaction is gathered in one place, however long it is.
    """
    if policy == "discard":
        return changes.where(~F.col("failed"))
    if policy == "transdiscard":
        return changes.join(failing(changes).select("xid"), "xid", "left_anti").select(*changes.columns)
    if policy != "sub_disable":
        raise ValueError(f"unknown policy: {policy}")
    starts = changes.groupBy("xid").agg(F.min(F.struct("commit_lsn", "seq")).alias("_start"))
    stop = F.broadcast(_failed_at(changes))
    early = starts.crossJoin(stop).where("_stop IS NULL OR _start < _stop").select("xid")
    return changes.join(early, "xid", "left_semi").select(*changes.columns)


def _failed_at(changes: DataFrame) -> DataFrame:
    """One row: where the first failing transaction starts, null if none fails."""
    starts = changes.groupBy("xid").agg(F.min(F.struct("commit_lsn", "seq")).alias("s"), F.bool_or("failed").alias("bad"))
    return starts.agg(F.min(F.when(F.col("bad"), F.col("s"))).alias("_stop"))


def exception_log(changes: DataFrame, policy: str = "transdiscard", logging: str = "all") -> DataFrame:
    """The changes to log, with the number of the change in its transaction and the message.

    With discard, the failed ones. Otherwise every change of a failed transaction; all but the culprit say that they
    were discarded because of it. With sub_disable, one more row a transaction says that the subscription was disabled.
    logging: none, discard (only with a policy that discards) or all.
    """
    if logging == "none" or (logging == "discard" and policy == "sub_disable"):
        return changes.limit(0).select("xid", "commit_lsn", "seq", F.lit(0).cast("bigint").alias("command_counter"), F.lit("").alias("operation"), F.lit("").alias("error_message"))
    order = W.partitionBy("xid").orderBy("commit_lsn", "seq")
    # Only what failing transactions hold is numbered.
    numbered = changes.join(failing(changes), "xid").withColumn("command_counter", F.row_number().over(order).cast("bigint"))
    culprit = F.min(F.when(F.col("failed"), F.col("command_counter"))).over(_txn())
    numbered = numbered.withColumn("_culprit", culprit)
    if policy == "discard":
        return numbered.where("failed").select("xid", "commit_lsn", "seq", "command_counter", F.col("op").alias("operation"), "error_message")
    if policy == "sub_disable":
        numbered = _only_first(numbered, changes)
    message = F.when(F.col("command_counter") == F.col("_culprit"), F.col("error_message")).otherwise(F.concat(F.lit("discarded due to exception at command_counter "), F.col("_culprit").cast("string")))
    rows = numbered.select("xid", "commit_lsn", "seq", "command_counter", F.col("op").alias("operation"), message.alias("error_message"))
    if policy == "sub_disable":
        last = rows.groupBy("xid").agg(F.max("commit_lsn").alias("commit_lsn"), F.max("seq").alias("seq"), (F.max("command_counter") + 1).alias("command_counter"))
        rows = rows.unionByName(last.select("*", F.lit("SUB_DISABLE").alias("operation"), F.lit("subscription disabled").alias("error_message")))
    return rows


def _only_first(numbered: DataFrame, changes: DataFrame) -> DataFrame:
    start = F.min(F.struct("commit_lsn", "seq")).over(_txn())
    return numbered.withColumn("_start", start).crossJoin(F.broadcast(_failed_at(changes))).where("_start = _stop").drop("_start", "_stop")
