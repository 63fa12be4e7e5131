"""Near-duplicates by MinHash with tensored banding.

A document's set is its distinct runs of SHINGLE words. Two collections of M keys each, a key being ROWS minima,
take 2 * M * ROWS hash functions; combining each key of one with each of the other gives M * M tables that ask for
2 * ROWS equal minima, which would take M times as many hash functions one by one. Two documents of similarity s meet
in a table unless all keys of one collection differ: with s = 0.8, M = 12 and ROWS = 3 that happens once in 2,800
pairs, with s = 0.9 once in 3 million.

Documents with the same set are one node, named after the smallest id, before anything else. In each table bucket every
document is paired with the bucket's smallest id (its hub), so that a bucket gives no more pairs than it has rows.
Links are confirmed on the full sets. Then documents with a hub in common that are not yet in one component are compared
unless something rules it out: the ratio of their sizes, the distances of both to the hub (1 - Jaccard similarity is a
metric, so their own distance is at least the difference), or sketches of four bits of 64 minima, which differ in more
than MAX_DIFFERENT places less than once in 100,000 pairs of similarity 0.8. These comparisons happen inside cells of a bounded
number of rows of a hub, a block of rows at a time, so that no table of pairs arises; rows of a hub's largest component
aren't compared with each other, so the work grows with the rows outside it times all rows. What comes out is one link
for any two components that have one. So no candidate of the tables goes unexamined, whatever the size of a bucket.

Defined results: null and empty texts, and those without words, have an empty set and link with nothing; a null id is
never linked and keeps null as component. An id stands for one node, also when it comes with several texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .components import components
from .words import LOWER, mix, word_hashes

M, ROWS, SEED, BROADCAST_IDS = 12, 3, 20, 500_000
#: Minima in a sketch; how many may differ.
SKETCH, MAX_DIFFERENT = 64, 28
#: Rows of one hub in a part of a cell, by sketch and by set, and elements of their sets; rows compared at once with a part.
BY_SKETCH, BY_SET, ITEMS, BLOCK_ROWS = 4096, 512, 1 << 20, 32
_NO_ITEMS, _LOWEST = 1 << 62, np.uint64(0x1111111111111111)
_RNG = np.random.default_rng(SEED)
_MUL = _RNG.integers(0, 2**63, 2 * M * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, 2 * M * ROWS, dtype=np.uint64)
_PLACE = mix(np.arange(1, 1 + 2 * M, dtype=np.uint64))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Hashes of the distinct runs of `size` words, in order; all words as one if there are fewer."""
    w = word_hashes((text or "").encode("utf-8", "replace").translate(LOWER))
    if not len(w):
        return w
    size = min(size, len(w))
    h = np.zeros(len(w) - size + 1, np.uint64)
    for i in range(size):
        h = mix(h * np.uint64(3) + w[i : len(w) - size + 1 + i])
    return np.unique(mix(h + np.uint64(size)))


def minima(h: np.ndarray) -> np.ndarray:
    """Of each hash function over the set, in blocks of the set, so that memory doesn't follow a long text."""
    low = np.full(len(_MUL), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 4096):
        x = h[None, at : at + 4096] * _MUL[:, None] + _ADD[:, None]
        low = np.minimum(low, (x ^ (x >> np.uint64(32))).min(axis=1))
    return low


def keys(low: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The keys of both collections, one after the other, and the sketch: four bits of each of 64 minima."""
    parts = low.reshape(2 * M, ROWS)
    h = _PLACE.copy()
    for r in range(ROWS):
        h = mix(h * np.uint64(5) + parts[:, r])
    four = (mix(low[:SKETCH]) >> np.uint64(60)).astype(np.uint8)
    return h.view(np.int64), (four[::2] | four[1::2] << 4).tobytes()


def signed(docs: DataFrame, size: int) -> DataFrame:
    """id, n and, for non-empty sets, digest, keys and sketch of every row."""

    def work(batches):
        for b in batches:
            n, digests, tables, bits = [], [], [], []
            for t in b.column(1).to_pylist():
                h = shingles(t, size)
                n.append(len(h))
                k = keys(minima(h)) if len(h) else (None, None)
                digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                tables.append(k[0])
                bits.append(k[1])
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(tables, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=["id", "n", "digest", "keys", "sketch"])

    return common.map_batches(docs, work, "id bigint, n bigint, digest binary, keys array<bigint>, sketch binary")


def table_keys() -> Column:
    """Each key of the first collection with each of the second: both are part of a table key, and so are their places."""
    first, second = F.slice("keys", 1, M), F.slice("keys", M + 1, M)
    return F.flatten(F.transform(first, lambda x: F.transform(second, lambda y: F.xxhash64(x, y))))


def few(ids: DataFrame) -> DataFrame:
    """The ids, to be sent to every executor if they are BROADCAST_IDS at most, which is checked here."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def with_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """id and set of the documents with these ids."""

    def sets(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([shingles(t, size).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["id", "set"])

    return common.map_batches(docs.join(few(ids), "id", "left_semi").select("id", "text"), sets, "id bigint, set binary")


def similarity(pairs: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) with the sizes of their sets' intersection and union, on the full sets."""
    own = with_sets(docs, pairs.select("a").union(pairs.select("b")).distinct().toDF("id"), size)
    both = pairs.join(own.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").join(own.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")

    def compare(batches):
        for b in batches:
            both, either = [], []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                common_ = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                both.append(common_)
                either.append(len(x) + len(y) - common_)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(both, pa.int64()), pa.array(either, pa.int64())], names=["a", "b", "both", "either"])

    return common.map_batches(both.select("a", "b", "set_a", "set_b"), compare, "a bigint, b bigint, both bigint, either bigint")


def cells(spokes: DataFrame, rows: int, items: int) -> DataFrame:
    """Deals each hub's rows so that any two of them that aren't both of its largest component meet in one cell.

    A hub's rows go to parts of about `rows` rows and `items` set elements; the parts of its largest component (whose
    rows need no comparing with each other) come after the others. Cell (hub, i, j) holds the parts i and j, `p` says
    which row is in which; i is never a part of the largest component.
    """
    by_root = spokes.groupBy("hub", "root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    most = by_root.groupBy("hub").agg(F.max(F.struct("c", (-F.col("root")).alias("r"), "s")).alias("m"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    parts = lambda c, s: F.ceil(F.greatest(c / rows, s / items))
    few = most.select("hub", (-F.col("m.r")).alias("main"), parts(F.col("c") - F.col("m.c"), F.col("s") - F.col("m.s")).alias("k"), parts(F.col("m.c"), F.col("m.s")).alias("k_main"))
    dealt, main = spokes.join(few, "hub"), F.col("root") == F.col("main")
    dealt = dealt.withColumn("p", F.pmod(F.xxhash64("b", F.lit(9)), F.when(main, F.col("k_main")).otherwise(F.col("k"))) + F.when(main, F.col("k")).otherwise(0))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1 + F.when(main, 0).otherwise(F.col("k_main")))))
    return dealt.withColumn("i", F.least("p", "o")).withColumn("j", F.greatest("p", "o")).drop("main", "k", "k_main", "o")


class Cell:
    """A cell's rows: those of part i, each to be compared with those of part j, BLOCK_ROWS at a time."""

    def __init__(self, t: pa.Table, percent: int):
        self.percent, self.reach = np.int64(percent), np.float32(1 - percent / 100 + 1e-6)
        self.b, self.root, self.n = (t.column(c).to_numpy() for c in ("b", "root", "n"))
        self.lo, self.hi = (t.column(c).to_numpy().astype(np.float32) for c in ("lo", "hi"))
        part, i, j = t.column("p").to_numpy(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
        self.left, self.right = np.flatnonzero(part == i), np.flatnonzero(part == j)

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Some rows of the left, and for each of them and each row on the right whether the two are in different components and may be similar."""
        r = self.right
        for at in range(0, len(self.left), BLOCK_ROWS):
            x = self.left[at : at + BLOCK_ROWS]
            open_ = self.root[x][:, None] != self.root[r]
            for i, k in enumerate(x):
                open_[i] &= (100 * self.n[r] >= self.percent * self.n[k]) & (100 * self.n[k] >= self.percent * self.n[r])
                open_[i] &= (self.lo[r] - self.hi[k] <= self.reach) & (self.lo[k] - self.hi[r] <= self.reach)
            yield x, open_


def differences(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many places the sketches of the rows of x differ from those of y, row by column."""
    out = np.zeros((len(x), len(y)), np.uint8)
    for w in range(x.shape[1]):
        d = x[:, w, None] ^ y[None, :, w]
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        d &= _LOWEST
        out += np.bitwise_count(d)
    return out


def open_rows(t: pa.Table, percent: int) -> np.ndarray:
    """Which rows of a cell may be similar to one that they are to be compared with."""
    cell, keep = Cell(t, percent), np.zeros(t.num_rows, bool)
    sketches = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(t.num_rows, -1)
    for x, open_ in cell.blocks():
        if open_.any():
            open_ &= differences(sketches[x], sketches[cell.right]) <= MAX_DIFFERENT
            keep[x] |= open_.any(axis=1)
            keep[cell.right] |= open_.any(axis=0)
    return keep


def still_open(spokes: DataFrame, percent: int) -> DataFrame:
    """The rows that may be similar to another one with the same hub, as far as sizes, distances and sketches tell."""

    def look(t: pa.Table) -> pa.Table:
        return t.filter(pa.array(open_rows(t, percent))).select(["hub", "b", "n", "root", "lo", "hi"])

    return cells(spokes, BY_SKETCH, _NO_ITEMS).groupBy("hub", "i", "j").applyInArrow(look, "hub bigint, b bigint, n bigint, root bigint, lo double, hi double").distinct()


def links_of(t: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links between the components of a cell's rows, on the full sets: one for any two components."""
    cell, links, joined = Cell(t, percent), [], set()
    sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
    lengths = np.array([len(sets[y]) for y in cell.right])
    words, flat = np.unique(np.concatenate([sets[y] for y in cell.right]), return_inverse=True) if len(lengths) else (np.zeros(0, np.uint64), np.zeros(0, int))
    flat, starts, mark = flat.astype(np.int32), np.cumsum(lengths) - lengths, np.zeros(len(words), np.int32)
    roots = cell.root[cell.right]
    for rows, open_ in cell.blocks():
        for i in np.flatnonzero(open_.any(axis=1)):
            x = rows[i]
            known = [y for a, y in joined if a == cell.root[x]]
            todo = open_[i] & ~np.isin(roots, known) if known else open_[i]
            if not todo.any():
                continue
            at = np.searchsorted(words, sets[x])
            at = at[at < len(words)]
            mine = at[np.isin(words[at], sets[x])]
            mark[mine] = 1
            both = np.add.reduceat(mark[flat], starts).astype(np.int64)
            mark[mine] = 0
            found = np.flatnonzero(todo & (100 * both >= percent * (lengths + len(sets[x]) - both)))
            found = found[np.unique(roots[found], return_index=True)[1]]
            links += [(int(cell.b[x]), int(cell.b[cell.right[y]])) for y in found]
            joined |= {(cell.root[x], roots[y]) for y in found}
    return links


def compared(spokes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between components that the rows of one hub give, on the full sets."""
    own = with_sets(docs, spokes.select(F.col("b").alias("id")).distinct(), size)
    met = cells(spokes, BY_SET, ITEMS).join(own.withColumnRenamed("id", "b"), "b")

    def look(t: pa.Table) -> pa.Table:
        links = links_of(t, percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return met.groupBy("hub", "i", "j").applyInArrow(look, "a bigint, b bigint").distinct()


def groups(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Two tables: node and root of each node with a link, and id, n and node of each row with a set."""
    rows = docs.select(F.col("doc_id").alias("id"), "text")
    marks = common.checkpointed(signed(rows, size))
    classes = common.checkpointed(marks.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))
    about = classes.select("node", "n", "sketch")
    bucket = W.partitionBy("key")
    tables = classes.select("node", F.explode(table_keys()).alias("key")).withColumn("hub", F.min("node").over(bucket))
    stars = tables.where("node <> hub").select("hub", "node").distinct()
    side = lambda x: about.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"))
    stars = common.checkpointed(stars.select(F.col("hub").alias("a"), F.col("node").alias("b")).join(side("b"), "b").join(side("a"), "a"))
    fits = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    tested = common.checkpointed(similarity(stars.where(fits).select("a", "b").distinct(), rows, size))
    linked = F.expr(f"100 * both >= {percent} * either")
    first = components(tested.where(linked))
    # Each node with its hubs: what is known of its distance to the hub, and its component so far.
    far = 1 - F.col("both") / F.col("either")
    spokes = stars.join(tested, ["a", "b"], "left").join(first.withColumnRenamed("node", "b"), "b", "left").select(
        F.col("a").alias("hub"), "b", F.col("n_b").alias("n"), F.coalesce("root", "b").alias("root"),
        F.coalesce(far, 1 - F.least("n_a", "n_b") / F.greatest("n_a", "n_b")).alias("lo"), F.coalesce(far, F.lit(1.0)).alias("hi"))
    mixed = spokes.groupBy("hub").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("hub")
    spokes = spokes.join(mixed, "hub").join(about.select(F.col("node").alias("b"), "sketch"), "b")
    unsure = common.checkpointed(still_open(spokes, percent))
    late = compared(unsure, rows, size, percent)
    roots = components(tested.where(linked).select("a", "b").unionByName(late))
    return roots, marks.select("id", "n", "digest").join(classes.select("digest", "node"), "digest", "left")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    roots, rows = groups(docs, size, percent)
    found = rows.join(roots, "node", "left").withColumn("component_id", F.coalesce("root", "node", "id"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents"), size=2)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id (and, of equal rows with that id, one)."""
    found = near_duplicates(docs)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    alone = docs.join(gone, "doc_id", "left_anti")
    # Rows that repeat an id in full are copies too; null ids are documents of their own.
    return alone.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(alone.where("doc_id is null"))


#: Two sets of similarity 0.8 share one of the rarest n - ceil(0.8 n) + 1 shingles of either (in one order for all), so only those are joined; links are counted on the full sets.
OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
s AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM g),
f AS (SELECT x, count(*) AS c FROM s GROUP BY x HAVING count(*) > 1),
o AS (SELECT s.doc_id, n, s.x, row_number() OVER (PARTITION BY s.doc_id ORDER BY coalesce(c, 1), s.x) AS i FROM s LEFT JOIN f USING (x)),
p AS (SELECT * FROM o WHERE i <= n - (80 * n + 99) // 100 + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
l AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND x.x = y.x GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT a, b FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
m AS (SELECT doc_id, min(other) AS low FROM r GROUP BY doc_id)
SELECT g.doc_id, len(g.g)::BIGINT AS n_shingles, least(g.doc_id, coalesce(low, g.doc_id)) AS component_id, g.doc_id = least(g.doc_id, coalesce(low, g.doc_id)) AS kept
FROM g LEFT JOIN m USING (doc_id)
"""
