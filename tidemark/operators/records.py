"""The rows that are kept of conflicts and of exceptions, with whole rows as text.

Both are projections beside what classified the change, and joins by position or key; nothing is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rendering
from tidemark.operators import resolve

# The columns of the two tables, in order.
RESOLUTIONS = ("id", "node_name", "log_time", "relname", "idxname", "conflict_type", "conflict_resolution", "local_origin", "local_tuple", "local_xid", "local_timestamp", "remote_origin", "remote_tuple", "remote_xid", "remote_timestamp", "remote_lsn")
EXCEPTIONS = ("remote_origin", "remote_commit_ts", "command_counter", "retry_errored_at", "remote_xid", "local_origin", "local_commit_ts", "table_schema", "table_name", "operation", "local_tup", "remote_old_tup", "remote_new_tup", "ddl_statement", "ddl_user", "error_message")


def _object(row: str, columns: Sequence[str]) -> Column:
    return F.when(F.col(row).isNotNull(), rendering.row_json(columns, row))


def _attributes(row: str, kinds: dict[str, str]) -> Column:
    """The row as a list of its columns with their types; values keep their kind in JSON, nulls are written."""
    one = [F.format_string('{"attname": %s, "atttype": %s, "value": %s}', F.lit(f'"{c}"'), F.lit(f'"{k}"'), _value(F.col(row)[c])) for c, k in kinds.items()]
    return F.when(F.col(row).isNotNull(), F.concat(F.lit("["), F.concat_ws(", ", *one), F.lit("]")))


def _value(c: Column) -> Column:
    """One value as JSON: what stands in a one-field object after its name. Null is written as such."""
    return F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}), r"^\{\"v\":([\s\S]*)\}$", 1), F.lit("null"))


def resolutions(met: DataFrame, columns: Sequence[str], node_name: str, nsp: str, rel: str, now: Column, idxname: str | None = None, save: bool = True) -> DataFrame:
    """The rows of saved conflicts, none with `save` off; types about origins alone are never saved.

    `met` has conflict_type, resolution, new, old, xid, commit_ts, commit_lsn, seq, origin_id and, of the local row,
    `local` (a struct of the columns, or null), `local_xid`, `_local_ts` and `_local_origin`. The remote row of a missing
    delete is its old one; a delete that loses has none. The id is a hash of the change's place, so that rows written
    again have the ids they had and no counter is shared.
    """
    kept = met.where(F.col("conflict_type").isin(*resolve.SAVED) & F.lit(save)).withColumn("_remote", F.when(F.col("conflict_type") == "delete_missing", F.col("old")).when(F.col("conflict_type") != "delete_exists", F.col("new")))
    name = F.concat(rendering.quote_ident(F.lit(nsp)), F.lit("."), rendering.quote_ident(F.lit(rel)))
    found = F.col("local").isNotNull()
    own = {
        "id": F.xxhash64("origin_id", "commit_lsn", "seq", F.lit(nsp), F.lit(rel)), "node_name": F.lit(node_name), "log_time": now, "relname": name, "idxname": F.lit(idxname).cast("string"), "conflict_resolution": F.col("resolution"),
        "local_origin": F.when(found, F.col("_local_origin")).cast("int"), "local_tuple": _object("local", columns), "local_xid": F.when(found, F.col("local_xid")), "local_timestamp": F.when(found, F.col("_local_ts")),
        "remote_origin": F.col("origin_id").cast("int"), "remote_tuple": _object("_remote", columns), "remote_xid": F.col("xid"), "remote_timestamp": F.col("commit_ts"), "remote_lsn": F.col("commit_lsn"),
    }
    return kept.select(*[own.get(c, F.col(c)).alias(c) for c in RESOLUTIONS])


def exceptions(log: DataFrame, changes: DataFrame, key: Sequence[str], kinds: dict[str, str], nsp: str, rel: str, now: Column, state: DataFrame | None = None) -> DataFrame:
    """The rows of an exception log (as errors.exception_log gives it) beside the changes they are about.

    `kinds` are the columns with their types. With `state` (key, columns, _ts, _origin), the local row that a change meets
    is kept too; without one its fields are null. Rows about no change (a subscription that was disabled) have no rows.
    """
    # The row that says that a subscription was disabled takes the last change's place, and its origin.
    of = changes.select("commit_lsn", "seq", "commit_ts", "origin_id", "old", "new", *key)
    both = log.join(of, ["commit_lsn", "seq"], "left")
    if state is None:
        both = both.withColumns({"_ts": F.lit(None).cast("timestamp_ntz"), "_origin": F.lit(None).cast("int"), "local": F.lit(None).cast("struct<" + ",".join(f"`{c}`:{k}" for c, k in kinds.items()) + ">")})
    else:
        both = both.join(state.select(*key, "_ts", "_origin", F.struct(*kinds).alias("local")), list(key), "left")
    about = F.col("operation") != "SUB_DISABLE"
    found = about & F.col("local").isNotNull()
    word = F.when(F.col("operation") == "I", "INSERT").when(F.col("operation") == "U", "UPDATE").when(F.col("operation") == "D", "DELETE").when(F.col("operation") == "T", "TRUNCATE").otherwise(F.col("operation"))
    own = {
        "remote_origin": F.col("origin_id").cast("int"), "remote_commit_ts": F.col("commit_ts"), "command_counter": F.col("command_counter").cast("int"), "retry_errored_at": now, "remote_xid": F.col("xid"),
        "local_origin": F.when(found, F.col("_origin")).cast("int"), "local_commit_ts": F.when(found, F.col("_ts")), "table_schema": F.when(about, F.lit(nsp)).otherwise(""), "table_name": F.when(about, F.lit(rel)).otherwise(""), "operation": word,
        "local_tup": F.when(about, _attributes("local", kinds)), "remote_old_tup": F.when(about, _attributes("old", kinds)), "remote_new_tup": F.when(about, _attributes("new", kinds)),
        "ddl_statement": F.lit(None).cast("string"), "ddl_user": F.lit(None).cast("string"), "error_message": F.coalesce("error_message", F.lit("unavailable")),
    }
    return both.select(*[own[c].alias(c) for c in EXCEPTIONS])


def statement_exceptions(failed: DataFrame, now: Column) -> DataFrame:
    """The same of control rows whose statement failed: origin_id, commit_ts, command_counter, xid, statement, role, error_message."""
    own = {"remote_origin": F.col("origin_id").cast("int"), "remote_commit_ts": F.col("commit_ts"), "command_counter": F.col("command_counter").cast("int"), "retry_errored_at": now, "remote_xid": F.col("xid"), "operation": F.lit("DDL"), "ddl_statement": F.col("statement"), "ddl_user": F.col("role"), "error_message": F.coalesce("error_message", F.lit("unavailable"))}
    missing = {"local_origin": "int", "local_commit_ts": "timestamp_ntz"}
    return failed.select(*[own.get(c, F.lit(None).cast(missing.get(c, "string"))).alias(c) for c in EXCEPTIONS])
