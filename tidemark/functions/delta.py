"""Commutative numeric merge: what a change adds to a column, added to the local value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Types that merge without a function of the user's own.
TYPES = ("smallint", "int", "bigint", "float", "double", "decimal")
#: Money is a decimal with two places, and merges as one.
MONEY = "decimal(19,2)"
Merge = Callable[[Column, Column, Column], Column]


def delta_apply(old: Column, new: Column, local: Column, kind: str) -> Column:
    """local + (new - old) in the column's own type; beyond its range is an error, as in ANSI mode."""
    kind = MONEY if kind == "money" else kind
    if kind.split("(")[0] not in TYPES:
        raise ValueError(f"no delta merge for {kind}")
    return (local + (new - old)).cast(kind)


def zero(kind: str) -> Column:
    """Where there is no old value, it counts as this."""
    kind = MONEY if kind == "money" else kind
    if kind.split("(")[0] not in TYPES:
        raise ValueError(f"no zero for {kind}")
    return F.lit(0).cast(kind)


class Registry:
    """Which function merges which column: the types' own, or one given for a column."""

    def __init__(self) -> None:
        self._own: dict[tuple[str, str], Merge] = {}

    def register(self, table: str, column: str, merge: Merge) -> None:
        self._own[table, column] = merge

    def merge(self, table: str, column: str, kind: str) -> Merge:
        return self._own.get((table, column)) or (lambda old, new, local: delta_apply(old, new, local, kind))

    def of(self, table: str, kinds: dict[str, str]) -> dict[str, Merge]:
        """The functions of these columns, as apply.fold takes them."""
        return {c: self.merge(table, c, k) for c, k in kinds.items()}
