"""Rows as text: JSON objects, attribute lists, log lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_KEEP_NULLS = {"ignoreNullFields": "false"}


def row_json(columns: Sequence[str], of: str | None = None) -> Column:
    """A JSON object with all the columns, nulls too."""
    return F.to_json(F.struct(*[F.col(f"{of}.{c}" if of else c).alias(c) for c in columns]), _KEEP_NULLS)


def attribute_list(kinds: Mapping[str, str]) -> Column:
    """[{"attname", "atttype", "value"}, ...] with every value as text."""
    one = lambda c, kind: F.struct(F.lit(c).alias("attname"), F.lit(kind).alias("atttype"), F.col(c).cast("string").alias("value"))
    return F.to_json(F.array(*[one(c, kind) for c, kind in kinds.items()]), _KEEP_NULLS)


def log_text(kinds: Mapping[str, str], cut: int = 40) -> Column:
    """`column[type]:value` of each column, nulls as (null), long values cut."""
    value = lambda c: F.coalesce(F.when(F.length(F.col(c).cast("string")) > cut, F.concat(F.substring(F.col(c).cast("string"), 1, cut), F.lit("..."))).otherwise(F.col(c).cast("string")), F.lit("(null)"))
    return F.concat_ws(" ", *[F.concat(F.lit(f"{c}[{kind}]:"), value(c)) for c, kind in kinds.items()])


def change_line(action: Column, table: str, key: Sequence[str], columns: Sequence[str], verbosity: str = "key_only") -> Column:
    """One JSON line for an applied change, every value quoted: nothing of the row, its key, or all of it."""
    shown = {"none": [], "key_only": list(key), "verbose": list(columns)}[verbosity]
    fields = [action.alias("action"), F.lit(table).alias("table")]
    if shown:
        fields.append(F.struct(*[F.col(c).cast("string").alias(c) for c in shown]).alias("row"))
    return F.to_json(F.struct(*fields), _KEEP_NULLS)


def error_message(message: Column, state: Column) -> Column:
    """The message with its SQLSTATE before it, unless that is the one for internal errors."""
    return F.when(F.coalesce(state, F.lit("XX000")) == "XX000", message).otherwise(F.concat(state, F.lit(": "), message))


#: Words that an identifier must be quoted for among plain ones; more may be given.
RESERVED = ("all", "and", "any", "array", "as", "asc", "both", "case", "cast", "check", "column", "constraint", "create", "default", "desc", "distinct", "do", "else", "end", "except", "false", "for", "foreign", "from", "grant", "group", "having", "in", "into", "limit", "not", "null", "offset", "on", "only", "or", "order", "primary", "references", "select", "table", "then", "to", "true", "union", "unique", "user", "using", "when", "where", "window", "with")


def quote_ident(name: Column, reserved: Sequence[str] = RESERVED) -> Column:
    """The identifier as SQL needs it written: in double quotes (those inside doubled) unless it is plain and not reserved."""
    plain = name.rlike("^[a-z_][a-z0-9_$]*$") & ~name.isin(list(reserved))
    return F.when(plain, name).otherwise(F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"')))


def identifier_list(names: Column) -> Column:
    """The identifiers of an array, quoted where needed, comma-joined."""
    return F.array_join(F.transform(names, lambda x: quote_ident(x)), ",")


def timestamp_text(ts: Column) -> Column:
    """A time in UTC with its microseconds and offset, as text."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00"))
