"""First copies of tables, catching up, and the states in between."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import publish

# The states of a subscription and of a table, in order.
SUBSCRIPTION_STATES = ("init", "structure", "data", "constraints", "catchup", "ready")
TABLE_STATES = ("init", "started", "data", "syncwait", "catchup", "syncdone", "ready", "failed")
#: How a table's state is shown.
SHOWN = {
    "init": "sync_init",
    "structure": "sync_structure",
    "data": "sync_data",
    "constraints": "sync_constraints",
    "syncwait": "sync_waiting",
    "catchup": "catchup",
    "syncdone": "synchronized",
    "ready": "replicating",
}
#: A sequence's cache starts with this and doubles to that at most.
SEQUENCE_CACHE, SEQUENCE_CACHE_MAX = 1000, 1_000_000


def shown(status: Column) -> Column:
    return reduce(lambda c, kv: c.when(status == kv[0], kv[1]), SHOWN.items(), F.when(F.lit(False), "")).otherwise("unknown")


def subscription_status(subscriptions: DataFrame, sync: DataFrame, running: DataFrame) -> DataFrame:
    """replicating, initializing, disabled, down or unknown, for each subscription. `running` has the subscriptions with a live query."""
    own = sync.where("rel IS NULL").select("sub_name", "status")
    met = subscriptions.join(own, "sub_name", "left").join(running.select("sub_name", F.lit(True).alias("_up")), "sub_name", "left")
    state = F.when(~F.col("enabled"), "disabled").when(F.col("status").isNull(), "unknown").when(F.col("_up").isNull(), "down").when(F.col("status") == "ready", "replicating").otherwise("initializing")
    return met.select("sub_name", state.alias("status"))


def copy(table: DataFrame, filters: Sequence[str] = (), columns: Sequence[str] | None = None, target: Sequence[str] | None = None, key: Sequence[str] = ()) -> DataFrame:
    """The first copy of a table: rows that any filter passes, columns that both sides have."""
    rows = publish.of_columns(publish.of_rows(table, filters, mode="copy"), columns, keep=key)
    return rows if target is None else rows.select(*[c for c in rows.columns if c in target])


def catch_up(changes: DataFrame, snapshot_lsn: int | Column) -> DataFrame:
    """What came after the copy."""
    return changes.where(F.col("commit_lsn") > snapshot_lsn)


def advanced(sync: DataFrame, applied: DataFrame) -> DataFrame:
    """Table states after so much was applied: a table whose copy is done is ready once everything up to its position is."""
    at = applied.select("sub_name", "applied_lsn")
    done = (F.col("status") == "syncdone") & (F.col("applied_lsn") >= F.col("status_lsn"))
    catching = (F.col("status") == "catchup") & (F.col("applied_lsn") >= F.col("status_lsn"))
    return sync.join(at, "sub_name", "left").withColumn("status", F.when(done, "ready").when(catching, "syncdone").otherwise(F.col("status"))).drop("applied_lsn")


def reconciled(saved: DataFrame, origins: DataFrame) -> DataFrame:
    """Saved progress against what the origin tracks: in-sync, stale (the file is behind), anomaly (it is ahead) or absent."""
    both = saved.select("node_id", F.col("remote_commit_lsn").alias("saved_lsn")).join(origins.select("node_id", "origin_lsn"), "node_id", "full_outer")
    state = F.when(F.col("saved_lsn").isNull(), "absent").when(F.col("origin_lsn").isNull() | (F.col("saved_lsn") > F.col("origin_lsn")), "anomaly").when(F.col("saved_lsn") < F.col("origin_lsn"), "stale").otherwise("in-sync")
    return both.withColumn("state", state)


def repaired(saved: DataFrame, origins: DataFrame) -> DataFrame:
    """Saved progress after a restart, made to agree with what the origin tracks: where the two positions differ, the
    tracked one counts, and the commit time, which belongs to the other position, is cleared; nodes that aren't saved are added.

    `saved` has node_id, remote_commit_lsn and remote_commit_ts; nodes that the origin doesn't track stay as they are.
    """
    both = saved.join(origins.select("node_id", "origin_lsn"), "node_id", "full_outer")
    same = F.col("origin_lsn").isNull() | F.coalesce(F.col("origin_lsn") == F.col("remote_commit_lsn"), F.lit(False))
    return both.select("node_id", F.coalesce("origin_lsn", "remote_commit_lsn").alias("remote_commit_lsn"), F.when(same, F.col("remote_commit_ts")).alias("remote_commit_ts"))


def sequences(state: DataFrame) -> DataFrame:
    """Which sequences to publish and with which value.

    `state` has seq_name, last_value, sent_value (what was published last, ahead of the sequence by its cache) and cache.
    A sequence is due unless what was published is still ahead of it by half of the smallest cache. Its cache doubles if
    all of what was sent and a whole cache more are used up; `in_time` is false if more than half a cache more is.
    """
    due = F.col("sent_value") < F.col("last_value") + SEQUENCE_CACHE // 2
    late = F.col("sent_value") + F.floor(F.col("cache") / 2) < F.col("last_value")
    fast = due & (F.col("sent_value") + F.col("cache") <= F.col("last_value"))
    marked = state.withColumns({"publish": due, "in_time": ~(due & late)})
    return marked.withColumn("cache", F.when(fast, F.least(F.col("cache") * 2, F.lit(SEQUENCE_CACHE_MAX))).otherwise(F.col("cache")).cast("bigint")).withColumn("sent_value", F.when(F.col("publish"), F.col("last_value") + F.col("cache")).otherwise(F.col("sent_value")))
