"""Progress, lag and counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COUNTERS = ("n_tup_ins", "n_tup_upd", "n_tup_del", "n_conflict", "n_dca")


def progress(records: DataFrame, key: Sequence[str] = ("dbid", "node_id", "remote_node_id")) -> DataFrame:
    """Records merged by key: what goes with the newest commit time (the first seen of equal ones); both positions by maximum of their own."""
    newest = F.max_by(F.struct("remote_commit_lsn", "prev_remote_ts", "updated_by_decode"), F.struct(F.col("remote_commit_ts"), -F.col("arrival")))
    merged = records.groupBy(*key).agg(F.max("remote_commit_ts").alias("remote_commit_ts"), newest.alias("_n"), F.max("remote_insert_lsn").alias("remote_insert_lsn"), F.max("received_lsn").alias("received_lsn"))
    return merged.select(*key, "remote_commit_ts", "_n.*", "remote_insert_lsn", "received_lsn")


def lag(progress_: DataFrame, nodes: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """For each pair of nodes: the largest distance from what was committed here to what the sender has written, in bytes,
    and from a commit there to the last news of it here, in seconds.

    `progress_` has last_updated_ts beside what progress() merges; `subscriptions` has origin_id and target_id. Progress
    without a subscription has no origin's name. Nothing is floored: a clock that runs ahead shows as a negative lag.
    """
    name = lambda n: F.broadcast(nodes.select(F.col("node_id").alias(f"{n}_id"), F.col("node_name").alias(f"{n}_name")))
    subs = F.broadcast(subscriptions.select(F.col("origin_id").alias("sub_origin"), F.col("target_id").alias("sub_target")).distinct())
    met = progress_.join(subs, (F.col("node_id") == F.col("sub_target")) & (F.col("remote_node_id") == F.col("sub_origin")), "left")
    met = met.join(name("origin"), F.col("sub_origin") == F.col("origin_id"), "left").join(name("receiver"), F.col("node_id") == F.col("receiver_id"), "left")
    seconds = F.timestamp_diff("SECOND", "remote_commit_ts", "last_updated_ts")
    newest = [F.max(x).alias(y) for x, y in (("remote_commit_ts", "commit_timestamp"), ("remote_commit_lsn", "commit_lsn"), ("remote_insert_lsn", "remote_insert_lsn"), ("received_lsn", "received_lsn"))]
    return met.groupBy("origin_name", "receiver_name").agg(*newest, F.max(F.col("remote_insert_lsn") - F.col("remote_commit_lsn")).alias("replication_lag_bytes"), F.max(seconds).cast("bigint").alias("replication_lag"))


def counters(applied: DataFrame, by: Sequence[str] = ("subid", "relid"), sender: bool = False, compat: bool = False) -> DataFrame:
    """The five counters of each key. compat counts deletes as updates on the receiving side, as the counters there always have."""
    op = F.col("op")
    as_update = op.isin("U", "D") if compat and not sender else op == "U"
    one = {"n_tup_ins": op == "I", "n_tup_upd": as_update, "n_tup_del": F.lit(False) if compat and not sender else op == "D"}
    conflict = F.col("conflict_type").isin("insert_exists", "update_exists", "delete_exists", "delete_missing") if "conflict_type" in applied.columns else F.lit(False)
    one |= {"n_conflict": conflict, "n_dca": F.col("delta") if "delta" in applied.columns else F.lit(False)}
    return applied.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in one.items()])


def table_stats(stats: DataFrame, subscriptions: DataFrame, tables: DataFrame) -> DataFrame:
    """Counters with names; those of dropped subscriptions and tables stay."""
    return stats.join(subscriptions.select("subid", "sub_name"), "subid", "left").join(tables.select("relid", "table_name"), "relid", "left").select("subid", "sub_name", "table_name", *COUNTERS)


def summary(stats: DataFrame) -> DataFrame:
    return stats.groupBy("subid", "sub_name").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def lsn_at(commits: DataFrame, ts: Column) -> DataFrame:
    """One row: the last position before the first commit that is newer than ts. Later commits don't count, even older ones.

    The first newer position is one row, found by an aggregation, so nothing is sorted.
    """
    first = commits.agg(F.min(F.when(F.col("commit_ts") > ts, F.col("commit_lsn"))).alias("_stop"))
    return commits.crossJoin(F.broadcast(first)).where("_stop IS NULL OR commit_lsn < _stop").agg(F.max("commit_lsn").alias("lsn"))


def commit_origin(xids: DataFrame, commits: DataFrame) -> DataFrame:
    """The time and origin of transactions, null where unknown."""
    return xids.join(commits.select("xid", "commit_ts", "origin_id"), "xid", "left")


def newest_of_origin(commits: DataFrame, origin: int, hits: int = 1000, reach: int = 1_000_000) -> DataFrame:
    """The newest commit of an origin among its last `hits` transactions, looking back over `reach` transaction ids."""
    last = commits.agg(F.max("xid").alias("_last"))
    near = commits.crossJoin(F.broadcast(last)).where((F.col("origin_id") == origin) & (F.col("xid") > F.col("_last") - reach))
    return near.orderBy(F.col("xid").desc()).limit(hits).agg(F.max("commit_ts").alias("commit_ts"))


def confirmed(slots: DataFrame, lsn: int) -> DataFrame:
    """One row: the oldest confirmed position, and whether all slots are there."""
    return slots.agg(F.min("confirmed_lsn").alias("oldest"), (F.coalesce(F.min("confirmed_lsn"), F.lit(lsn)) >= lsn).alias("reached"))


def peers(progress_: DataFrame, nodes: DataFrame, subscriptions: DataFrame, own: str, provider: str) -> DataFrame:
    """What the provider knows of its other peers, for a new node to start from."""
    n = nodes.select("node_id", "node_name")
    known = progress_.join(n, "node_id").where(F.col("node_name") == provider)
    remote = n.select(F.col("node_id").alias("remote_node_id"), F.col("node_name").alias("peer"))
    subs = subscriptions.select(F.col("origin_id").alias("remote_node_id"), F.col("target_id").alias("node_id"), "sub_name")
    return known.join(remote, "remote_node_id").join(subs, ["remote_node_id", "node_id"], "left").where(F.col("peer") != own).select("peer", "sub_name", "remote_commit_ts", "remote_commit_lsn")


def running_max_break(commits: DataFrame) -> DataFrame:
    """Commits with the newest time so far, by origin: where it exceeds their own, clocks run apart."""
    so_far = W.partitionBy("origin_id").orderBy("commit_lsn").rowsBetween(W.unboundedPreceding, W.currentRow)
    return commits.withColumn("newest_so_far", F.max("commit_ts").over(so_far))
