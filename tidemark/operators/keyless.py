"""Changes applied to a table without a key, where a change names its row by all values.

A table is a number of copies for each row's values, nulls being equal. An insert adds a copy; a delete takes one; an update
takes one of the old row and adds one of the new. What finds no copy is missing and has no effect, so the new row of a
missing update isn't there for later changes either. Numbers of copies can't fall below zero: a change is missing when the
running sum of copies, had all come through, reaches a new lowest value below zero. So each row's changes need a
window over running sums and no fold; and as only updates tie one row's number to another's, rounds are repeated until the same
updates are missing as in the round before. A round more is right for at least one update more of those that hang on
one another, so the rounds are as many as the longest such chain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.apply import _kept

#: Copies of a row that one step writes.
COPIES = 10_000


def _judged(start: DataFrame, changes: DataFrame, columns: Sequence[str], lost: DataFrame | None) -> DataFrame:
    """A row for each copy that comes or goes, with `missing`; `lost` are the updates whose new rows don't come."""
    came = changes if lost is None else changes.join(lost, ["commit_lsn", "seq"], "left_anti")

    def moves(rows: DataFrame, side: str, step: int) -> DataFrame:
        return rows.select(*[F.col(f"{side}.{c}").alias(f"_v_{c}") for c in columns], "commit_lsn", "seq", "op", F.lit(step).cast("bigint").alias("_step"))

    both = start.unionByName(moves(changes.where("op IN ('U', 'D')"), "old", -1)).unionByName(moves(came.where("op IN ('I', 'U')"), "new", 1))
    # What is there at the start has no position and comes first; an update takes before it adds.
    order = W.partitionBy(*[f"_v_{c}" for c in columns]).orderBy("commit_lsn", "seq", "_step")
    summed = both.withColumn("_sum", F.sum("_step").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    low = F.least(F.lit(0), F.min("_sum").over(order.rowsBetween(W.unboundedPreceding, -1)))
    return summed.withColumn("_low", low).withColumn("missing", (F.col("_step") == -1) & (F.col("_sum") < F.col("_low"))).drop("_sum", "_low")


def applied(rows: DataFrame, changes: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The table after all changes, and the position and op of the changes that found no row.

    `changes` has commit_lsn, seq (no two alike, no nulls), op, and old and new, structs of the columns. Tables and
    changes may be empty; an update to the same values is one that finds its row and leaves it.
    """
    kinds, own = dict(changes.select("commit_lsn", "seq").dtypes), [f"_v_{c}" for c in columns]
    start = rows.groupBy(*[F.col(c).alias(v) for c, v in zip(columns, own, strict=True)]).agg(F.count("*").alias("_step"))
    start = start.select(*own, *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()], F.lit("").alias("op"), "_step")
    lost, before = None, None
    while True:
        judged = _kept(_judged(start, changes, columns, lost))
        lost = judged.where("missing AND op = 'U'").select("commit_lsn", "seq")
        now = lost.agg(F.count("*"), F.sum(F.xxhash64("commit_lsn", "seq").cast("decimal(38,0)"))).first()
        if now == before or (before is None and now[0] == 0):
            break
        before = now
    # What is missing took nothing.
    left = judged.groupBy(*own).agg((F.sum("_step") + F.count_if("missing")).alias("_n")).where("_n > 0")
    blocks = left.withColumn("_b", F.explode(F.expr(f"sequence(0, (_n - 1) div {COPIES})")))
    table = blocks.withColumn("_c", F.explode(F.expr(f"sequence(1, least({COPIES}, _n - _b * {COPIES}))")))
    return table.select(*[F.col(v).alias(c) for c, v in zip(columns, own, strict=True)]), judged.where("missing").select("commit_lsn", "seq", "op")
