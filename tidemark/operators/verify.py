"""Whether tables and sets agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def md5_agg(value: Column) -> Column:
    """An aggregate: h = md5(h || value) over the values in order, from the empty text; a null makes it null.

    The chain needs a group's values in one place: use it for groups of a bounded size, and `checksum` for tables.
    """
    text = value.cast("string")
    chain = F.aggregate(F.array_sort(F.collect_list(text)), F.lit(""), lambda h, x: F.md5(F.concat(h, x).cast("binary")))
    return F.when(F.count_if(text.isNull()) == 0, chain)


def checksum(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows and the sum of row hashes, in any order: partial sums are combined before the shuffle, so it suits tables of any size."""
    row = F.xxhash64(*[F.col(c) for c in sorted(table.columns)]).cast("decimal(38,0)")
    return table.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(row).alias("checksum"))


def table_diff(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys whose rows differ: only_left, only_right or different."""
    rest = [c for c in left.columns if c not in key]
    a = left.select(*key, F.struct(*rest).alias("_a"))
    b = right.select(*key, F.struct(*rest).alias("_b"))
    kind = F.when(F.col("_b").isNull(), "only_left").when(F.col("_a").isNull(), "only_right").otherwise("different")
    return a.join(b, list(key), "full_outer").where("NOT (_a <=> _b)").select(*key, kind.alias("difference"))


def set_diff(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Members of one of two sets, with the side that has them; nulls are equal."""
    a, b = (x.select(*columns).distinct() for x in (left, right))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns]
    only = lambda x, y, side: x.alias("a").join(y.alias("b"), same, "left_anti").withColumn("side", F.lit(side))
    return only(a, b, "left").unionByName(only(b, a, "right"))


def all_tables(tables: DataFrame, memberships: DataFrame) -> DataFrame:
    """Tables with their sets; those in none appear with a null set, system schemas not at all."""
    user = tables.where("nsp NOT RLIKE '^pg_'")
    inside = user.join(memberships.select("relid", "set_name"), "relid").select("relid", "nsp", "rel", "set_name")
    outside = user.join(memberships.select("relid"), "relid", "left_anti").select("relid", "nsp", "rel", F.lit(None).cast("string").alias("set_name"))
    return inside.unionByName(outside).distinct()


def members(tables: DataFrame, sequences: DataFrame, sets: Sequence[str] | None = None) -> DataFrame:
    """Tables and sequences of the sets (all without any) as one list, each name once: set_name, rel and kind."""
    both = tables.select("set_name", "rel", F.lit("table").alias("kind")).unionByName(sequences.select("set_name", F.col("seq").alias("rel"), F.lit("sequence").alias("kind")))
    return (both if sets is None else both.where(F.col("set_name").isin(list(sets)))).distinct()


def listed(rows: DataFrame, by: Sequence[str], name: str, order: str) -> DataFrame:
    """For each group its names in order, as an array and as comma-joined text. For catalog rows, whose groups are small."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).alias("n"))))
    found = rows.groupBy(*by).agg(F.transform(pairs, lambda p: p["n"]).alias("names"))
    return found.withColumn("text", F.array_join("names", ","))
