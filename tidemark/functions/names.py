"""Names and ids of nodes, subscriptions and slots; version comparison; intervals."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The version of the catalog's interface and the range of protocol versions.
VERSION, VERSION_NUMBER, MIN_PROTOCOL, MAX_PROTOCOL = "6.0.0", 60000, 4, 5
# A slot name's prefix, the length of its parts and of the whole.
SLOT_PREFIX, PART, NAME = "spk", 16, 63


def shortened(name: Column, size: int = PART) -> Column:
    """The name if it is short enough, else its start and a hash of the whole, `size` long together."""
    return F.when(F.length(name) <= size, name).otherwise(F.concat(F.substring(name, 1, size - 8), F.substring(F.md5(name), 1, 8)))


def slot_name(database: Column, provider: Column, subscription: Column) -> Column:
    whole = F.concat_ws("_", F.lit(SLOT_PREFIX), *[shortened(x) for x in (database, provider, subscription)])
    return F.substring(F.regexp_replace(F.lower(whole), "[^a-z0-9_]", "_"), 1, NAME)


def node_id(name: Column) -> Column:
    """16 bits of a stable hash of the name; ids may also be given."""
    return F.crc32(name.cast("binary")).bitwiseAND(0xFFFF).cast("int")


def tiebreaker(info: Column, node: Column) -> Column:
    """The whole number that the node's info names as such, else the node's id."""
    return F.coalesce(F.get_json_object(info, "$.tiebreaker").try_cast("int"), node)


def valid_subscription(name: str) -> bool:
    return re.fullmatch("[a-z0-9_]{1,63}", name) is not None


def version_parts(version: Column) -> Column:
    """The numbers of a dotted version, as an array that compares as versions do."""
    return F.transform(F.split(F.regexp_extract(version, r"^(\d+(?:\.\d+)*)", 1), r"\."), lambda x: x.try_cast("int"))


def interval_ms(months: Column, days: Column, micros: Column) -> Column:
    """Milliseconds, with months of 30 days and days of 24 hours."""
    return ((months.cast("bigint") * 30 + days) * 86_400_000 + F.floor(micros / 1000)).cast("bigint")
