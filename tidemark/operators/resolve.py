"""Conflicts between a remote change and the local row: who wins, what it is called, what is logged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RESOLVERS = ("last_update_wins", "first_update_wins", "apply_remote", "keep_local", "error")
#: Types that are saved in the resolutions table and counted; the two about origins are only logged.
SAVED = ("insert_exists", "update_exists", "update_missing", "delete_exists", "delete_missing")
TYPES = ("insert_exists", "update_origin_differs", "update_exists", "update_missing", "delete_origin_differs", "delete_missing", "delete_exists")


def remote_wins(local_ts: Column, local_origin: Column, remote_ts: Column, remote_origin: Column, own_tiebreaker: Column, remote_tiebreaker: Column, resolver: str = "last_update_wins") -> Column:
    """By timestamp; equal ones: the remote if the row came from the same origin or the tiebreakers are equal, else the lower tiebreaker.

    The tiebreakers are those of the applying and the sending node, whatever the origin of the row.
    """
    if resolver in ("apply_remote", "keep_local"):
        return F.lit(resolver == "apply_remote")
    if resolver == "error":
        return F.raise_error(F.lit("conflict, and the resolver is error")).cast("boolean")
    tie = (local_origin == remote_origin) | (remote_tiebreaker <= own_tiebreaker)
    newer = remote_ts > local_ts if resolver == "last_update_wins" else remote_ts < local_ts
    return F.coalesce(F.when(remote_ts == local_ts, tie).otherwise(newer), F.lit(True))


def conflict_type(op: Column, present: Column, same_origin: Column, wins: Column) -> Column:
    """The conflict's name, null if there is none to report."""
    return (
        F.when((op == "I") & present, "insert_exists")
        .when((op == "U") & ~present, "update_missing")
        .when((op == "U") & ~same_origin, "update_origin_differs")
        .when((op == "D") & ~present, "delete_missing")
        .when((op == "D") & ~wins, "delete_exists")
        .when((op == "D") & ~same_origin, "delete_origin_differs")
    )


def resolution(kind: Column, wins: Column) -> Column:
    skip = kind.isin("delete_exists", "delete_missing", "update_missing")
    return F.when(kind.isNotNull(), F.when(skip, "skip").when(wins, "apply_remote").otherwise("keep_local"))


def newest(rows: DataFrame, key: Sequence[str], resolver: str = "last_update_wins") -> DataFrame:
    """One row a key: the last update (or the first). Without deletes and with ties inside one origin only, what applying all in order leaves.

    One aggregation that combines before the shuffle.
    """
    rest = [c for c in rows.columns if c not in key]
    order = F.struct("commit_ts", "commit_lsn", "seq")
    pick = F.max_by if resolver == "last_update_wins" else F.min_by
    return rows.groupBy(*key).agg(pick(F.struct(*rest), order).alias("r")).select(*key, "r.*")


def against(changes: DataFrame, state: DataFrame, key: Sequence[str], own_tiebreaker: int, tiebreakers: Column, columns: Sequence[str] = ()) -> DataFrame:
    """Each change beside the local row it meets in a fixed state: conflict_type and resolution; with `columns` also
    `local`, a struct of these, and `local_xid`, from the state's _xid if it has one."""
    kept = [F.struct(*columns).alias("local"), (F.col("_xid") if "_xid" in state.columns else F.lit(None).cast("bigint")).alias("local_xid")] if columns else []
    local = state.select(*key, F.col("_ts").alias("_local_ts"), F.col("_origin").alias("_local_origin"), F.lit(True).alias("_present"), *kept)
    met = changes.join(local, list(key), "left").withColumn("_present", F.coalesce("_present", F.lit(False)))
    wins = remote_wins(F.col("_local_ts"), F.col("_local_origin"), F.col("commit_ts"), F.col("origin_id"), F.lit(own_tiebreaker), tiebreakers)
    same = F.coalesce(F.col("_local_origin") == F.col("origin_id"), F.lit(False))
    kind = conflict_type(F.col("op"), F.col("_present"), same, wins)
    return met.withColumn("conflict_type", kind).withColumn("resolution", resolution(kind, wins)).drop("_present")


def counts(conflicts: DataFrame, by: Sequence[str] = ("subid",)) -> DataFrame:
    """The number of each type, a column each."""
    return conflicts.groupBy(*by).agg(*[F.count_if(F.col("conflict_type") == t).alias(f"confl_{t}") for t in TYPES])


def retained(resolutions: DataFrame, now: Column, days: int) -> DataFrame:
    """Without what is older than so many days; 0 keeps all."""
    return resolutions if days == 0 else resolutions.where(F.col("log_time") >= now - F.expr(f"INTERVAL {int(days)} DAYS"))


def unique_probe(incoming: DataFrame, state: DataFrame, key: Sequence[str], columns: Sequence[str], nulls_distinct: bool = True, where: str | None = None) -> DataFrame:
    """Incoming rows that another local row (by key) already meets on a unique index; a partial index counts for both rows.

    Of several the smallest key.
    """
    if where:
        incoming, state = incoming.where(where), state.where(where)
    if nulls_distinct:
        incoming, state = (x.dropna(subset=list(columns)) for x in (incoming, state))
    # A row meets the smallest key of its value or, if that is its own, the second smallest.
    seen = state.select(*[F.col(c).alias(f"_v_{c}") for c in columns], F.struct(*key).alias("_k"))
    values = [F.col(f"_v_{c}") for c in columns]
    least = seen.groupBy(*values).agg(F.min("_k").alias("_first"))
    again = [F.col(f"_v_{c}").eqNullSafe(F.col(f"_w_{c}")) for c in columns]
    lows = least.select(*[F.col(f"_v_{c}").alias(f"_w_{c}") for c in columns], "_first")
    two = seen.join(lows, again).groupBy(*values).agg(F.first("_first").alias("_first"), F.min(F.when(F.col("_k") != F.col("_first"), F.col("_k"))).alias("_second"))
    same = [F.col(c) == F.col(f"_v_{c}") if nulls_distinct else F.col(c).eqNullSafe(F.col(f"_v_{c}")) for c in columns]
    met = incoming.distinct().join(two, same).withColumn("_met", F.when(F.struct(*key) != F.col("_first"), F.col("_first")).otherwise(F.col("_second")))
    return met.where("_met IS NOT NULL").select(*incoming.columns, *[F.col("_met")[k].alias(f"met_{k}") for k in key])


def with_previous(rows: DataFrame, value: str, by: Sequence[str] = ("origin_id",), order: str = "commit_lsn", ranges: int = 200) -> DataFrame:
    """The rows with `_before`, the value of the row before in its group, null for the first one.

    Groups may be few and large: each is cut at quantiles of the order, rows look back inside their range, and what a
    range ends with is carried to the next one that has rows, from an aggregation with a row for each range.
    """
    cuts = rows.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("_cuts"))
    cut = rows.crossJoin(F.broadcast(cuts)).withColumn("_range", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(order))), F.lit(0))).drop("_cuts")
    inside = W.partitionBy(*by, "_range").orderBy(order)
    ends = cut.groupBy(*by, "_range").agg(F.max_by(F.struct(value), order).alias("_end"))
    carried = ends.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_at"), F.lag("_end").over(W.partitionBy(*by).orderBy("_range")).alias("_carried"))
    same = [F.col("_range") == F.col("_at"), *[F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]]
    looked = cut.withColumns({"_lag": F.lag(value).over(inside), "_nth": F.row_number().over(inside)})
    met = looked.join(carried, same, "left")
    return met.select(*rows.columns, F.when(F.col("_nth") > 1, F.col("_lag")).otherwise(F.col("_carried")[value]).alias("_before"))


def commit_order_breaks(transactions: DataFrame, by: Sequence[str] = ("origin_id",)) -> DataFrame:
    """Transactions whose predecessor isn't the one they name."""
    return with_previous(transactions, "commit_ts", by).where("_before IS NOT NULL AND NOT (prev_commit_ts <=> _before)").drop("_before")


def without(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows of a table without a key after deletes that name whole rows: each takes one of the equal rows, nulls equal nulls."""
    return rows.exceptAll(deleted.select(*rows.columns))


def missing(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """The deletes that find no row left to take."""
    return deleted.select(*rows.columns).exceptAll(rows)
