"""Which changes of a table are sent: by table, action, row, column, origin and position.

All of these are predicates and projections, so they reach the scan; only the repair filter needs an order, inside one
transaction.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACTIONS = {"I": "replicate_insert", "U": "replicate_update", "D": "replicate_delete", "T": "replicate_truncate"}


def policies(memberships: DataFrame, sets: DataFrame, subscribed: Sequence[str]) -> DataFrame:
    """One row a table: masks are ORed over the subscribed sets, column lists are united (a set without one adds nothing), row filters listed."""
    mine = memberships.join(F.broadcast(sets.where(F.col("set_name").isin(list(subscribed)))), "set_name")
    masks = [F.bool_or(m).alias(m) for m in ACTIONS.values()]
    columns = F.array_sort(F.array_distinct(F.flatten(F.collect_list("columns"))))
    return mine.groupBy("rel").agg(*masks, F.when(F.size(columns) > 0, columns).alias("columns"), F.array_sort(F.collect_list("row_filter")).alias("row_filters"))


def of_tables(changes: DataFrame, allowed: DataFrame) -> DataFrame:
    """Changes of member tables whose actions are sent. `allowed` has a row a table, as policies() gives it."""
    mask = reduce(lambda c, a: c.when(F.col("op") == a, F.col(ACTIONS[a])), ACTIONS, F.when(F.lit(False), False))
    return changes.join(allowed.select("rel", *ACTIONS.values()), "rel").where(mask).drop(*ACTIONS.values())


def of_actions(changes: DataFrame, actions: str) -> DataFrame:
    return changes.where(F.col("op").isin(list(actions)))


def truncates(changes: DataFrame, memberships: DataFrame, sets: DataFrame) -> DataFrame:
    """Truncates go out if any set of the node with the table sends them, subscribed or not; CASCADE isn't passed on."""
    sending = memberships.join(sets.where("replicate_truncate"), "set_name").select("rel").distinct()
    return changes.where("op = 'T'").join(sending, "rel", "left_semi")


def of_rows(changes: DataFrame, filters: Sequence[Column | str], mode: str = "stream") -> DataFrame:
    """Rows that the filters let pass: all of them on the stream, any of them in the first copy. Unknown is no, as everywhere in a WHERE."""
    if not filters:
        return changes
    each = [F.expr(f) if isinstance(f, str) else f for f in filters]
    return changes.where(reduce((lambda a, b: a & b) if mode == "stream" else (lambda a, b: a | b), each))


def on_image(columns: Sequence[str]) -> list[Column]:
    """What a row filter sees: the new row if there is one, else the old one (which has the key alone)."""
    return [F.coalesce(F.col(f"new.{c}"), F.when(F.col("new").isNull(), F.col(f"old.{c}"))).alias(c) for c in columns]


def of_columns(rows: DataFrame, columns: Sequence[str] | None, keep: Sequence[str] = (), generated: Sequence[str] = ()) -> DataFrame:
    """The listed columns (all without a list) and those to keep, never generated ones; filter first, as filters may use the rest."""
    return rows.select(*[c for c in rows.columns if (columns is None or c in columns or c in keep) and c not in generated])


def of_origins(changes: DataFrame, forward: Sequence[str] = ()) -> DataFrame:
    """Local changes always, others only if they are forwarded."""
    return changes.where(F.col("origin_id").isNull() | (F.col("origin_id") == 0) | F.lit(bool(forward)))


def outside_repair(changes: DataFrame) -> DataFrame:
    """Without what stands between a repair message ON and the OFF or the end of its transaction."""
    before = W.partitionBy("xid").orderBy("commit_lsn", "seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    told = F.last(F.when(F.col("op") == "M", F.col("message")), ignorenulls=True).over(before)
    return changes.withColumn("_told", told).where("op <> 'M' AND coalesce(_told, '') <> 'repair_on'").drop("_told")


def but_lsn(changes: DataFrame, skip: int | None) -> DataFrame:
    """Without the one transaction that ends there."""
    return changes if skip is None else changes.where(F.col("commit_lsn") != skip)


def of_ready_tables(changes: DataFrame, sync: DataFrame) -> DataFrame:
    """Changes of tables that are ready or have no state, or whose copy is done and lies before the change."""
    state = F.broadcast(sync.select("rel", "status", "status_lsn"))
    return changes.join(state, "rel", "left").where("status IS NULL OR status = 'ready' OR (status = 'syncdone' AND status_lsn <= commit_lsn)").drop("status", "status_lsn")


def first_sent(changes: DataFrame) -> DataFrame:
    """Of transactions that several senders of a group offer, each once."""
    return changes.dropDuplicates(["end_lsn", "seq"])


def of_schemas(rows: DataFrame, skip: Sequence[str], column: str = "nsp") -> DataFrame:
    return rows.where(~F.col(column).isin(list(skip))) if skip else rows


def queued_for(queue: DataFrame, sets: Sequence[str]) -> DataFrame:
    """Control rows without sets are for all; others for subscribers to any of theirs."""
    return queue.where(F.col("sets").isNull() | F.arrays_overlap("sets", F.array(*[F.lit(s) for s in sets])))


#: Words that may not be in a row filter: it is one boolean expression over the table's own columns, the same every time.
_BARRED = ("select ", " over ", "rand(", "randn(", "uuid(", "now(", "current_", "input_file", "monotonically", "spark_partition", "count(", "sum(", "min(", "max(", "avg(", "collect_", "explode(")


#: Functions that a row filter may call, all of them the same every time, and words that stand before a bracket without being one.
ALLOWED_FUNCTIONS = frozenset("abs ceil ceiling floor round sign sqrt power mod greatest least coalesce nullif ifnull nvl isnull isnotnull length char_length upper lower trim ltrim rtrim btrim substring substr left right concat replace split_part startswith endswith contains position instr date_trunc year month day hour minute second date get_json_object cast try_cast bigint int double string decimal boolean md5 sha2 crc32".split())
_WORDS = frozenset("and or not in case when then else between like is interval decimal".split())


def called(text: str) -> set[str]:
    """The names before an opening bracket, outside quoted text."""
    bare = re.sub(r"'(?:[^']|'')*'", "''", text.lower())
    return set(re.findall(r"([a-z_][a-z0-9_]*)\s*\(", bare)) - _WORDS


def checked_filter(table: DataFrame, text: str, allowed: frozenset[str] = ALLOWED_FUNCTIONS) -> Column:
    """The filter as a column; an error if it isn't one deterministic boolean over the table's columns, made of allowed functions."""
    low = f" {' '.join(text.lower().split())} "
    if any(w in low for w in _BARRED) or ";" in text or called(text) - allowed:
        raise ValueError(f"not a row filter: {text}")
    kind = table.select(F.expr(text)).dtypes
    if [k for _, k in kind] != ["boolean"]:
        raise ValueError(f"a row filter must be one boolean: {text}")
    return F.expr(text)


def dependent_columns(table: DataFrame, text: str) -> list[str]:
    """Columns that a filter uses and that so can't be dropped."""

    def refused(c: str) -> bool:
        try:
            table.drop(c).select(F.expr(text)).schema  # noqa: B018  analysis alone
            return False
        except Exception:
            return True

    return [c for c in table.columns if refused(c)]
