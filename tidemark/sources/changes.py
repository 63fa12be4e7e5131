"""Change streams: the envelope, its JSON form, files of it, and one derived from the events table.

A change has a position (commit_lsn, seq), its transaction (xid, commit_ts), its provenance (origin_id, 0 for local),
the operation (I, U, D, T for truncate, M for a message), and the row: `new`, `old` where sent, and `changed`, the columns
that were sent (null: all of them). One DataFrame holds the changes of one table, so that rows keep their types.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSITION = ("commit_lsn", "seq")


def envelope(row: T.StructType) -> T.StructType:
    """The schema of changes to a table with these columns."""
    head = "commit_lsn bigint, end_lsn bigint, commit_ts timestamp_ntz, prev_commit_ts timestamp_ntz, xid bigint, seq int, origin_id int, origin_name string, nsp string, rel string, op string"
    out = T.StructType.fromDDL(head)
    return out.add("old", row).add("new", row).add("changed", T.ArrayType(T.StringType()))


def from_json(lines: DataFrame, row: T.StructType, column: str = "value") -> DataFrame:
    """Changes from one JSON document a line; lines that aren't JSON have null everywhere and are kept for the exception log."""
    return lines.select(F.from_json(column, envelope(row)).alias("c")).select("c.*")


def to_json(changes: DataFrame) -> DataFrame:
    """One JSON document a change; null fields are written, unchanged columns aren't (`changed` names the sent ones)."""
    return changes.select(F.to_json(F.struct(*changes.columns), {"ignoreNullFields": "false"}).alias("value"))


def read_changes(spark: SparkSession, path: str, row: T.StructType, fmt: str = "json", stream: bool = False) -> DataFrame:
    """Files of changes, as a batch or a stream; fmt is any of Spark's: json, parquet, orc, csv without nested rows."""
    reader = (spark.readStream if stream else spark.read).schema(envelope(row))
    return reader.format(fmt).load(path)


def aligned(rows: DataFrame, schema: T.StructType, defaults: dict[str, str] | None = None) -> DataFrame:
    """Columns by name: those that the target has and the source doesn't get their default; unknown ones are an error."""
    unknown = [c for c in rows.columns if c not in schema.names]
    if unknown:
        raise ValueError(f"columns that the target lacks: {', '.join(unknown)}")
    fill = lambda f: F.col(f.name) if f.name in rows.columns else F.expr((defaults or {}).get(f.name, "NULL"))
    return rows.select(*[fill(f).cast(f.dataType).alias(f.name) for f in schema.fields])


def from_events(events: DataFrame) -> DataFrame:
    """A change stream over user_id: sign-ups insert, errors delete, all else updates; three origins whose clocks differ."""
    origin = F.col("event_id") % 3
    late = F.when(origin == 1, F.expr("INTERVAL 6 HOURS")).when(origin == 2, F.expr("INTERVAL 12 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))
    op = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")
    row = lambda c: F.when(F.col("event_type") != "error", F.col(c)).alias(c)
    return events.select(
        F.col("event_id").alias("commit_lsn"), (F.col("event_id") % 4).alias("seq"), F.floor(F.col("event_id") / 4).cast("bigint").alias("xid"),
        origin.alias("origin_id"), (F.col("ts") - late).alias("commit_ts"), op.alias("op"), F.col("user_id").alias("key"), row("event_type"), row("value"), row("props"),
    )


#: The same stream in SQL, as the table ch.
EVENTS_SQL = """
ch AS (SELECT event_id AS commit_lsn, event_id % 4 AS seq, event_id // 4 AS xid, event_id % 3 AS origin_id,
  CASE event_id % 3 WHEN 1 THEN ts - INTERVAL 6 HOURS WHEN 2 THEN ts - INTERVAL 12 HOURS ELSE ts END AS commit_ts,
  CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op, user_id AS key,
  CASE WHEN event_type <> 'error' THEN event_type END AS event_type,
  CASE WHEN event_type <> 'error' THEN value END AS value,
  CASE WHEN event_type <> 'error' THEN props END AS props FROM events)
"""


def compared(columns: Sequence[str]) -> list:
    """The row of a flat change as a struct, for operators that take `new`."""
    return [F.struct(*columns).alias("new")]
