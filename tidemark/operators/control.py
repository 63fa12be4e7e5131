"""What control rows ask for: copies of tables, values of sequences, changes of columns; sync events and waiting for them;
copies made again; apply delay; progress that a new node inherits.

Rows of data stay in DataFrames. Control rows that change columns, and waiting, are the few things that the driver does
one after the other.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.catalog import CatalogError

# The kinds of control rows.
KINDS = {"Q": "sql", "D": "ddl", "A": "table sync", "S": "sequence"}
#: States of a table from which its copy may be made again.
SETTLED = ("ready", "syncdone", "none", "failed")
SYNC_EVENT = "sync_event"


def table_message(nsp: str, rel: str) -> dict:
    return {"schema_name": nsp, "table_name": rel}


def sequence_message(nsp: str, seq: str, value: int) -> dict:
    return {"schema_name": nsp, "sequence_name": seq, "last_value": str(value)}


def _of_kind(queue: DataFrame, kind: str, *fields: str) -> DataFrame:
    return queue.where(F.col("kind") == kind).select("seq", *[F.get_json_object("message", f"$.{f}").alias(f) for f in fields])


def unknown(queue: DataFrame) -> DataFrame:
    """Control rows of no known kind: an error for whoever applies them."""
    return queue.where(~F.col("kind").isin(*KINDS))


def table_syncs(queue: DataFrame, sync: DataFrame, sub_name: str) -> DataFrame:
    """Table states with those that the queue asks to copy: new ones start, those that have a state are left alone."""
    asked = _of_kind(queue, "A", "schema_name", "table_name").select(F.lit(sub_name).alias("sub_name"), F.col("schema_name").alias("nsp"), F.col("table_name").alias("rel")).distinct()
    new = asked.join(sync, ["sub_name", "nsp", "rel"], "left_anti").select("*", F.lit("init").alias("status"), F.lit(None).cast("bigint").alias("status_lsn"))
    return sync.select(*new.columns).unionByName(new)


def sequence_values(queue: DataFrame, sequences: DataFrame) -> DataFrame:
    """Sequences (nsp, seq_name, last_value) with the values that the queue sets, the last of each; unknown ones are left out."""
    sent = _of_kind(queue, "S", "schema_name", "sequence_name", "last_value")
    last = sent.groupBy(F.col("schema_name").alias("nsp"), F.col("sequence_name").alias("seq_name")).agg(F.max_by(F.col("last_value").cast("bigint"), "seq").alias("_sent"))
    return sequences.join(last, ["nsp", "seq_name"], "left").select("nsp", "seq_name", F.coalesce("_sent", "last_value").cast("bigint").alias("last_value"))


def evolved(table: DataFrame, step: dict) -> DataFrame:
    """The table after one change of its columns: {"add": name, "type": ..., "default": expression}, {"drop": name},
    {"rename": name, "to": name} or {"retype": name, "type": ...}. Names that are there (or aren't) are errors; "if_exists" and "if_not_exists" let them pass.
    """
    verb = next((v for v in ("add", "drop", "rename", "retype") if v in step), None)
    if verb is None:
        raise ValueError(f"not a change of columns: {step}")
    name, there = step[verb], step[verb] in table.columns
    if verb == "add":
        if there and step.get("if_not_exists"):
            return table
        if there:
            raise ValueError(f"column {name} exists")
        return table.withColumn(name, F.expr(step.get("default") or "NULL").cast(step["type"]))
    if not there:
        if step.get("if_exists"):
            return table
        raise ValueError(f"no column {name}")
    if verb == "drop":
        return table.drop(name)
    if verb == "retype":
        return table.withColumn(name, F.col(name).cast(step["type"]))
    if step["to"] in table.columns:
        raise ValueError(f"column {step['to']} exists")
    return table.withColumnRenamed(name, step["to"])


def statements(queue: DataFrame) -> DataFrame:
    """Statements in the order they were queued: seq, role, and the statement as its text."""
    return queue.where(F.col("kind").isin("Q", "D")).select("seq", "role", F.col("message").alias("statement")).orderBy("seq")


def dispatch(queue: DataFrame, tables: dict[str, DataFrame], policy: str = "transdiscard") -> tuple[dict[str, DataFrame], list[tuple[int, str]]]:
    """The tables after the changes of columns that the queue holds for them, and the control rows that failed with their messages.

    A statement is {"table": name, ...} with one step of `evolved`. With discard and transdiscard a failing one is logged and
    left out; with sub_disable it is the last one looked at. Statements are few, and streamed to the driver one by one.
    """
    out, failed = dict(tables), []
    for r in statements(queue).toLocalIterator():
        try:
            step = json.loads(r["statement"])
            if step["table"] not in out:
                raise ValueError(f"no table {step['table']}")
            out[step["table"]] = evolved(out[step["table"]], step)
        except (ValueError, KeyError, TypeError) as e:
            failed.append((r["seq"], str(e)))
            if policy == "sub_disable":
                break
    return out, failed


# Sync events


def sync_events(changes: DataFrame) -> DataFrame:
    """The positions of sync events in a stream, by origin."""
    return changes.where((F.col("op") == "M") & (F.col("message") == SYNC_EVENT)).select("origin_id", "commit_lsn")


def event_reached(events: DataFrame, progress: DataFrame, subscriptions: DataFrame, target: int) -> DataFrame:
    """Each event with what waiting for it at `target` would find now: reached, waiting, disabled or no subscription."""
    subs = subscriptions.where(F.col("target_id") == target).select("origin_id", "enabled")
    at = progress.where(F.col("node_id") == target).select(F.col("remote_node_id").alias("origin_id"), F.col("remote_commit_lsn").alias("_at"))
    met = events.join(subs, "origin_id", "left").join(at, "origin_id", "left")
    state = F.when(F.col("enabled").isNull(), "no subscription").when(~F.col("enabled"), "disabled").when(F.col("_at") >= F.col("commit_lsn"), "reached").otherwise("waiting")
    return met.select("origin_id", "commit_lsn", state.alias("state"))


def wait_for(look: Callable[[], str], timeout: float = 0, wait_if_disabled: bool = False, pause: float = 0.2) -> bool:
    """Waits until `look` (a state of event_reached, read anew each time) says reached; false after `timeout` seconds, 0 waits on.

    A subscription that is missing or disabled is an error unless it may be waited for.
    """
    start = time.monotonic()
    while True:
        state = look()
        if state == "reached":
            return True
        if state in ("disabled", "no subscription") and not wait_if_disabled:
            raise CatalogError(f"can't wait for the event: {state}")
        if timeout and time.monotonic() - start >= timeout:
            return False
        time.sleep(pause)


# Copies made again


def resynced(sync: DataFrame, sub_name: str, nsp: str, rel: str, read_only: str = "off") -> DataFrame:
    """Table states with this table's copy to be made again. It mustn't be under way, nor the node read-only."""
    if read_only != "off":
        raise CatalogError(f"{nsp}.{rel} can't be copied again: the node is read-only")
    # The subscription's own state has no table.
    mine = F.coalesce((F.col("sub_name") == sub_name) & (F.col("nsp") == nsp) & (F.col("rel") == rel), F.lit(False))
    now = sync.where(mine).select("status").first()
    if now is not None and now["status"] not in SETTLED:
        raise CatalogError(f"{nsp}.{rel} is being copied")
    if now is None:
        one = sync.sparkSession.range(1).select(F.lit(sub_name).alias("sub_name"), F.lit(nsp).alias("nsp"), F.lit(rel).alias("rel"), F.lit("init").alias("status"), F.lit(None).cast("bigint").alias("status_lsn"))
        return sync.select(*one.columns).unionByName(one)
    return sync.withColumns({"status": F.when(mine, "init").otherwise(F.col("status")), "status_lsn": F.when(~mine, F.col("status_lsn"))})


def all_synced(sync: DataFrame, sub_name: str, remote: DataFrame) -> DataFrame:
    """Table states of a subscription against the provider's tables (nsp, rel): those without a state start, those that
    the provider no longer sends lose theirs; others stay as they are."""
    keep = (F.col("sub_name") != sub_name) | F.coalesce(F.col("_sent"), F.lit(False)) | F.col("rel").isNull()
    sent = remote.select("nsp", "rel").distinct()
    left = sync.join(sent.withColumn("_sent", F.lit(True)), ["nsp", "rel"], "left").where(keep).select(*sync.columns)
    new = sent.join(sync.where(F.col("sub_name") == sub_name), ["nsp", "rel"], "left_anti").select(F.lit(sub_name).alias("sub_name"), "nsp", "rel", F.lit("init").alias("status"), F.lit(None).cast("bigint").alias("status_lsn"))
    return left.unionByName(new)


def copied_again(local: DataFrame, snapshot: DataFrame, key: Sequence[str], truncate: bool = True) -> DataFrame:
    """The table after its copy was made again: the snapshot alone or, without truncating, beside what is there; a key that is there already is an error."""
    if truncate:
        return snapshot.select(*local.columns)
    if not local.join(snapshot, list(key), "left_semi").isEmpty():
        raise CatalogError("the copy meets keys that are there; truncate first")
    return local.unionByName(snapshot.select(*local.columns))


# Delay, inherited progress


def after_delay(transactions: DataFrame, now: Column, delay_ms: int) -> DataFrame:
    """What may be applied at `now` if each transaction waits until so long after its commit. One that isn't due holds
    back all behind it; commits in the future are clocks that run ahead, and don't wait."""
    if delay_ms <= 0:
        return transactions
    # timestampadd keeps the type of the commit times.
    due = (F.col("commit_ts") >= now) | (F.timestamp_add("MILLISECOND", F.lit(delay_ms), "commit_ts") <= now)
    stop = F.broadcast(transactions.agg(F.min(F.when(~due, F.col("commit_lsn"))).alias("_stop")))
    return transactions.crossJoin(stop).where("_stop IS NULL OR commit_lsn < _stop").drop("_stop")


def inherited(progress: DataFrame, provider: int, target: int) -> DataFrame:
    """Progress of a new node from its provider's: what the copy already holds of other nodes, the new node itself left out.

    The last commit counts as the one before it and as all that was received.
    """
    own = progress.where((F.col("node_id") == provider) & (F.col("remote_node_id") != target))
    return own.withColumns({"node_id": F.lit(target).cast(progress.schema["node_id"].dataType), "prev_remote_ts": F.col("remote_commit_ts"), "received_lsn": F.col("remote_commit_lsn")})


def overwritten(progress: DataFrame, forced: DataFrame, key: Sequence[str] = ("node_id", "remote_node_id")) -> DataFrame:
    """Progress in which the forced rows take the place of those with their key, even newer ones."""
    return progress.join(forced, list(key), "left_anti").select(*progress.columns).unionByName(forced.select(*progress.columns))


def forwarded(progress: DataFrame, changes: DataFrame, node_id: int) -> DataFrame:
    """Progress rows for transactions that came through another node: each origin's newest commit is also that origin's progress here."""
    newest = F.max_by(F.struct("commit_lsn", "commit_ts"), F.struct("commit_ts", "commit_lsn")).alias("_n")
    seen = changes.where("origin_id <> 0").groupBy(F.col("origin_id").alias("remote_node_id")).agg(newest)
    new = seen.select(F.lit(node_id).alias("node_id"), "remote_node_id", F.col("_n.commit_lsn").alias("remote_commit_lsn"), F.col("_n.commit_ts").alias("remote_commit_ts"))
    both = progress.select(*new.columns).unionByName(new)
    return both.groupBy("node_id", "remote_node_id").agg(F.max_by(F.struct("remote_commit_lsn", "remote_commit_ts"), F.struct("remote_commit_ts", "remote_commit_lsn")).alias("_n")).select("node_id", "remote_node_id", "_n.*")


# Statistics


def since_reset(applied: DataFrame, resets: DataFrame, by: Sequence[str] = ("subid",)) -> DataFrame:
    """Applied changes that count since their subscription's statistics were last reset; `resets` has `by` and reset_lsn."""
    last = resets.groupBy(*by).agg(F.max("reset_lsn").alias("_reset"))
    return applied.join(last, list(by), "left").where("_reset IS NULL OR commit_lsn > _reset").drop("_reset")
