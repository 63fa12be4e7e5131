"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions alone.

A source with n of the q parts of a cycle owes one block every q / n slots: its block k (from 0) is released at
slot floor(k q / n) and due before slot ceil((k + 1) q / n). Each slot takes, of the released blocks, the one with
the earliest deadline (equal ones: by source name). Then no source is ever a whole block ahead of its target or
behind it. The pattern repeats every q slots (of whole numbers without a common divisor), so it is worked out for one cycle only
and every document finds its slot by division: no step goes through the documents one after another. Sources with the
same n have the same releases and deadlines, so among them the blocks come in order of (k, name), and a cycle takes one
counter for each different n: without given weights 100 at most, whatever the number of sources.

A block is BLOCK_ROWS documents of one source in order of doc_id. To number a source's rows without gathering a
large source in one task, rows are counted in ranges of doc_id first, cut at quantiles; a row's number is the count of
the ranges before its own plus its place in that range.

Nothing is dropped: when a source runs out, its slots stay empty and the rest go on in slot order.

Defined results: a null source is a source of its own, last in name order of ties; null ids come first in their
source; rows with equal ids are in order of the text's hash; an empty table gives no rows; columns may have any names,
but those named `_block` or `_slot` are replaced. The weights are whole numbers; without any, a source gets
round(100 * sqrt(rows / rows of the largest source)) parts, at least 1. The cycle is made in one task from one row
for each different n, in time that grows with its slots. Rows alike in source and id are numbered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Rows of a block; rows that a range is meant to have, and the most ranges; up to so many sources, the cycle goes to every task.
BLOCK_ROWS, RANGE_ROWS, MAX_RANGES, BROADCAST_SOURCES = 8, 1_000, 4_095, 10_000
#: Picks are gathered in arrays of so many, as each addition copies its array.
_PICKS = 256


def _div(a: Column, b: Column) -> Column:
    """The whole part of a / b, for a >= 0."""
    return ((a - a % b) / b).cast("bigint")


def _gcd(a: Column, b: Column) -> Column:
    """The largest common divisor; 90 steps are enough for any two 64-bit numbers."""
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(90)), F.struct(a.alias("a"), b.alias("b")), step, lambda s: s["a"])


def parts_of(docs: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """source and its parts n."""
    counts = docs.groupBy("source").agg(F.count("*").alias("c"))
    if weights is None:
        return counts.select("source", F.greatest(F.lit(1), F.round(100 * F.sqrt(F.col("c") / F.max("c").over(W.partitionBy(F.lit(0)))))).cast("bigint").alias("n"))
    given = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.lit(None).cast("map<string,int>")
    return counts.select("source", F.greatest(F.lit(1), F.coalesce(F.try_element_at(given, F.col("source")), F.lit(1))).cast("bigint").alias("n"))


def cycle(parts: DataFrame) -> DataFrame:
    """source, its blocks n in a cycle, the cycle's slots q, and `slots`: for each of the n blocks, its slot from 0 to q - 1."""
    by_name = W.orderBy(F.col("source").isNull(), "source")
    named = parts.select("source", "n", F.row_number().over(by_name).alias("pos"))
    # One row: for each different n, by `i`, the places in name order of the sources that have it.
    lists = named.groupBy("n").agg(F.array_sort(F.collect_list("pos")).alias("pos"))
    one = lists.agg(F.array_sort(F.collect_list(F.struct("n", "pos"))).alias("raw"))
    one = one.withColumn("d", F.aggregate("raw", F.lit(0).cast("bigint"), lambda d, x: _gcd(d, x["n"])))
    one = one.withColumn("g", F.transform("raw", lambda x, i: F.struct(_div(x["n"], F.col("d")).alias("n"), F.size(x["pos"]).cast("bigint").alias("size"), x["pos"].alias("pos"), i.alias("i"))))
    one = one.select("g", F.aggregate("g", F.lit(0).cast("bigint"), lambda q, x: q + x["n"] * x["size"]).alias("q"))
    # An aggregation, below which nothing of the following is pushed: it would be worked out anew at each step.
    one = one.agg(F.first("g").alias("g"), F.first("q").alias("q"))

    def head(x, j):
        """The j-th block of the sources with this n: deadline and name order, by which blocks compare, and release."""
        k, q = _div(j, x["size"]), F.col("q")
        due, release = _div((k + 1) * q + x["n"] - 1, x["n"]), _div(k * q, x["n"])
        return F.struct(due.alias("due"), F.get(x["pos"], (j % x["size"]).cast("int")).alias("pos"), x["i"].alias("i"), release.alias("release"), j.alias("j"))

    def step(state, t):
        pick = F.array_min(F.filter(state["heads"], lambda h: h["release"] <= t))["i"]
        full = F.size(state["last"]) >= _PICKS
        # In an array of one, the pick is worked out once and not again for each use.
        return F.transform(F.array(pick), lambda p: F.struct(
            F.transform(state["heads"], lambda h: F.when(h["i"] == p, head(F.get("g", p), h["j"] + 1)).otherwise(h)).alias("heads"),
            F.when(full, F.concat(state["done"], F.array(state["last"]))).otherwise(state["done"]).alias("done"),
            F.when(full, F.array(p)).otherwise(F.concat(state["last"], F.array(p))).alias("last")))[0]

    start = F.struct(F.transform("g", lambda x: head(x, F.lit(0).cast("bigint"))).alias("heads"), F.array().cast("array<array<int>>").alias("done"), F.array().cast("array<int>").alias("last"))
    every = F.when(F.col("q") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("q") - 1)).otherwise(F.array().cast("array<bigint>"))
    picks = F.aggregate(every, start, step, lambda s: F.flatten(F.concat(s["done"], F.array(s["last"]))))
    taken = one.select("g", "q", picks.alias("picks")).select("q", F.posexplode_outer("picks").alias("t", "i"), F.expr("g[i].n").alias("n"), F.expr("g[i].size").alias("size"), F.expr("g[i].pos").alias("all_pos")).where("t IS NOT NULL")
    taken = taken.withColumn("j", F.row_number().over(W.partitionBy("i").orderBy("t")) - 1)
    owned = taken.select("q", "n", "t", F.expr("all_pos[j % size]").alias("pos")).groupBy("pos", "n", "q").agg(F.array_sort(F.collect_list(F.col("t").cast("bigint"))).alias("slots"))
    return owned.join(named.select("source", "pos"), "pos").select("source", "n", "q", "slots")


def _range_of(docs: DataFrame, rows: int) -> Column:
    """The number of the range of ids that a row is in; null ids come before, in ranges by the text's hash."""
    cuts = min(MAX_RANGES, rows // RANGE_ROWS)
    found = docs.agg(F.percentile_approx("doc_id", [(i + 1) / (cuts + 1) for i in range(cuts)], 4 * MAX_RANGES)).first()[0] if cuts else None
    bounds = F.array(*[F.lit(x).cast("bigint") for x in sorted(set(found or ()))])
    # A search by halves among the bounds, which are MAX_RANGES at most.
    look = lambda low, bit: F.when(F.coalesce(F.get(bounds, low + bit - 1) <= F.col("id"), F.lit(False)), low + bit).otherwise(low)
    place = F.aggregate(F.array(*[F.lit(1 << b) for b in reversed(range(MAX_RANGES.bit_length()))]), F.lit(0), look) if found else F.lit(0)
    return F.when(F.col("id").isNull(), F.shiftright("h", 52).cast("int") - 10_000).otherwise(place)


def mix(docs: DataFrame, weights: dict[str, int] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows with `_block`, their block's number in its source, and `_slot`, where that block goes."""
    kept = [c for c in docs.columns if c not in ("_block", "_slot")]
    seen = docs.agg(F.count("*").alias("rows"), F.count_distinct("source").alias("sources")).first()
    # The table's own columns travel in a struct, so that their names can't clash with those made here.
    rows = docs.select(F.col("source").alias("s"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    rows = rows.withColumn("r", _range_of(docs, seen["rows"]))
    before = W.partitionBy("s").orderBy("r").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("s", "r").agg(F.count("*").alias("c")).select(F.col("s").alias("s_"), F.col("r").alias("r_"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    own = W.partitionBy("s", "r").orderBy(F.col("id").asc_nulls_first(), "h")
    numbered = rows.withColumn("at", F.row_number().over(own) - 1).join(starts, F.col("s").eqNullSafe(F.col("s_")) & (F.col("r") == F.col("r_")))
    blocks = numbered.select("s", "row", F.floor((F.col("start") + F.col("at")) / block_rows).alias("block"))
    turns = cycle(parts_of(docs, weights)).withColumnRenamed("source", "s_")
    turns = F.broadcast(turns) if seen["sources"] <= BROADCAST_SOURCES else turns
    placed = blocks.join(turns, F.col("s").eqNullSafe(F.col("s_")))
    slot = F.floor(F.col("block") / F.col("n")) * F.col("q") + F.get("slots", F.pmod("block", "n").cast("int"))
    return placed.select("row.*", F.col("block").alias("_block"), slot.alias("_slot"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", F.col("_block").alias("block"), F.col("_slot").alias("slot"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of their blocks' slots; a column `slot`, where they have one, takes these."""
    rows = mix(docs).repartitionByRange("_slot", "doc_id").sortWithinPartitions("_slot", "doc_id")
    return rows.select(*[F.col("_slot").alias("slot") if c == "slot" else F.col(f"`{c}`") for c in docs.columns])


OP10_SQL = f"""
WITH RECURSIVE c AS (SELECT source, count(*) AS c FROM documents GROUP BY source),
p AS (SELECT source, greatest(1, round(100 * sqrt(c / max(c) OVER ())))::BIGINT AS n FROM c),
l AS (SELECT list(n ORDER BY source NULLS LAST) AS ns, list(source ORDER BY source NULLS LAST) AS names, sum(n)::BIGINT AS q FROM p),
r(t, ks, pick) AS (
  SELECT -1::BIGINT, list_transform(ns, lambda x: 0::BIGINT), 0::BIGINT FROM l
  UNION ALL
  SELECT t + 1, list_transform(ks, lambda k, i: k + CASE WHEN i = p THEN 1 ELSE 0 END), p::BIGINT FROM (
    SELECT t, ks, list_position(d, list_min(d)) AS p FROM (
      SELECT t, ks, list_transform(ns, lambda n, i: CASE WHEN ks[i] * q < (t + 2) * n THEN ((ks[i] + 1) * q + n - 1) // n END) AS d
      FROM r, l WHERE t + 1 < q))),
s AS (SELECT names[pick] AS source, ns[pick] AS n, q, t, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM r, l WHERE t >= 0),
b AS (SELECT doc_id, source, ((row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1) // {BLOCK_ROWS})::BIGINT AS block FROM documents)
SELECT b.doc_id, b.source, b.block, ((b.block // s.n) * s.q + s.t)::BIGINT AS slot
FROM b JOIN s ON b.source IS NOT DISTINCT FROM s.source AND b.block % s.n = s.k
"""
