"""Near-duplicate embeddings by a small-world graph per shard.

Equal vectors are one point. Points are dealt to shards by a hash, each with a graph of its own, and every point is
looked up in every shard, in blocks of BLOCK queries, each of which loads the shard's graph once. A query whose whole beam
is linked to it is looked up again with twice the beam, until the beam reaches past its links; and in each block AUDIT
queries, and as many of those that have links, are compared with brute force, and all are looked up again with twice the
beam until the share of true links found, each query's match with itself aside, is RECALL. A beam of more than 1 / WIDEST
of the shard would cost more than comparing with all of it, and couldn't cross from one part of a graph to another that
isn't connected with it; so beyond that the queries are compared with the whole shard. The cosine
of what was found is then computed in double precision. A task reports each query's number of links and, of the links
themselves, a spanning forest only, so that a large group of copies never becomes a table of pairs.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component link with nothing; vectors
of different length never link. Rows that repeat a vec_id count as vectors of their own. A null id has no component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components
from .hnsw import BATCH, BEAM, Graph

COSINE, SHARD_POINTS, LEAST_SHARDS, BLOCK, AUDIT, RECALL, WIDEST = 0.95, 50_000, 4, 16_384, 48, 0.99, 8


def _unit(rows: list[list[float]] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and in float32."""
    x = np.asarray(rows, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x, x.astype(np.float32)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else flat.chunk(0)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def points(vectors: DataFrame) -> DataFrame:
    """One row for each different usable vector: the smallest id, how many have it, dimension and embedding."""
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.where("vec_id is not null").where(F.coalesce(good, F.lit(False)))
    return rows.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")).withColumn("dim", F.size("embedding"))


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links (a, b), and the smallest node that it reaches by them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, (x, y) = np.arange(len(nodes)), at.reshape(2, -1)
    while True:
        least = root.copy()
        np.minimum.at(least, x, root[y])
        np.minimum.at(least, y, root[x])
        least = least[least]
        if (least == root).all():
            return nodes, nodes[root]
        root = least


def _looked_up(graph: Graph, q32: np.ndarray, beam: int, low: np.float32) -> tuple[np.ndarray, np.ndarray]:
    """Rows of queries and points that the graph gives as near, beams widened for queries with more links than a beam holds."""
    n, pairs, todo = len(graph.points), [], np.arange(len(q32))
    while len(todo) and beam * WIDEST <= n:
        wide, step = [], max(1, min(BATCH, (1 << 24) // n))
        for i in range(0, len(todo), step):
            rows = todo[i : i + step]
            ids, sims = graph.search(q32[rows], beam)
            full = (sims[:, -1] >= low) & (ids[:, -1] >= 0)
            wide.append(rows[full])
            a, k = np.nonzero((sims >= low) & (ids >= 0) & ~full[:, None])
            pairs.append((rows[a], ids[a, k]))
        todo, beam = np.concatenate(wide), 2 * beam
    for i in range(0, len(todo), max(1, (1 << 22) // n)):
        rows = todo[i : i + max(1, (1 << 22) // n)]
        a, b = np.nonzero(q32[rows] @ graph.points.T >= low)
        pairs.append((rows[a], b))
    return tuple(np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in (0, 1))


def linked(graph: Graph, exact: np.ndarray, q: np.ndarray, q32: np.ndarray, threshold: float = COSINE, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Rows of queries and points whose cosine is at least the threshold, and the recall of the last audit.

    `own` has the row of the point that each query is itself, or -1.
    """
    low, n = np.float32(threshold - 1e-5), len(exact)
    own = np.full(len(q), -1) if own is None else own
    pick = np.random.default_rng(len(q))
    audit = pick.choice(len(q), min(AUDIT, len(q)), replace=False)
    beam, first = min(BEAM, n), True
    while True:
        a, b = _looked_up(graph, q32, beam, low)
        parts = [np.einsum("kd,kd->k", q[a[i : i + 65536]], exact[b[i : i + 65536]]) >= threshold for i in range(0, len(a), 65536)]
        true = np.concatenate(parts) if parts else np.zeros(0, bool)
        a, b = a[true], b[true]
        others = b != own[a]
        if first:
            have = np.unique(a[others])
            audit = np.union1d(audit, pick.choice(have, min(AUDIT, len(have)), replace=False))
            truth = q[audit] @ exact.T >= threshold
            truth[np.arange(len(audit))[own[audit] >= 0], own[audit][own[audit] >= 0]] = False
            first = False
        found = (np.isin(a, audit) & others).sum()
        recall = 1.0 if not truth.sum() else found / truth.sum()
        if recall >= RECALL or beam * WIDEST > n:
            return a, b, float(recall)
        beam = 2 * beam


def links(pts: DataFrame, shards: int) -> DataFrame:
    """id with either `found`, the number of vectors linked to it in a shard, or `root`, which it is connected with there; and the audits' recall."""
    rows = pts.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))

    def build(table: pa.Table) -> pa.Table:
        raw = _matrix(table.column("embedding"))
        g = Graph.build(_unit(raw)[1])
        return pa.table({
            "dim": table.column("dim")[:1], "shard": table.column("shard")[:1], "entry": pa.array([g.entry], pa.int64()),
            "ids": pa.array([table.column("id").to_numpy().astype(np.int64).tobytes()], pa.binary()), "copies": pa.array([table.column("copies").to_numpy().astype(np.int64).tobytes()], pa.binary()),
            "points": pa.array([raw.tobytes()], pa.binary()), "links": pa.array([[x.tobytes() for x in g.layers]], pa.list_(pa.binary())),
        })

    graphs = common.checkpointed(rows.groupBy("dim", "shard").applyInArrow(build, "dim int, shard bigint, entry bigint, ids binary, copies binary, points binary, links array<binary>"))
    blocks = pts.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    queries = pts.join(blocks, "dim").select("dim", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard"), "id", "embedding")
    dealt = graphs.join(blocks, "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).drop("blocks")

    def look_up(graph: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("id", pa.int64()), ("found", pa.int64()), ("root", pa.int64()), ("recall", pa.float64())])
        if not graph.num_rows or not asked.num_rows:
            return schema.empty_table()
        g = {k: graph.column(k)[0].as_py() for k in ("entry", "ids", "copies", "points", "links")}
        ids, copies = np.frombuffer(g["ids"], np.int64), np.frombuffer(g["copies"], np.int64)
        dim = graph.column("dim")[0].as_py()
        exact, unit = _unit(np.frombuffer(g["points"], np.float64 if len(g["points"]) == 8 * dim * len(ids) else np.float32).reshape(len(ids), dim))
        layers = [np.frombuffer(x, np.int32).reshape(len(ids), -1) for x in g["links"]]
        own = asked.column("id").to_numpy().astype(np.int64)
        q, q32 = _unit(_matrix(asked.column("embedding")))
        sorted_, order = np.sort(ids), np.argsort(ids)
        at = np.minimum(np.searchsorted(sorted_, own), len(ids) - 1)
        a, b, recall = linked(Graph(unit, layers, g["entry"]), exact, q, q32, own=np.where(sorted_[at] == own, order[at], -1))
        other = own[a] != ids[b]
        a, b = a[other], b[other]
        found = np.bincount(a, weights=copies[b], minlength=len(own)).astype(np.int64)
        nodes, roots = _roots(own[a], ids[b])
        none = np.zeros(len(nodes), bool)
        return pa.table([
            np.concatenate([own, nodes]), pa.array(np.concatenate([found, np.zeros(len(nodes), np.int64)]), mask=np.concatenate([np.zeros(len(own), bool), ~none])),
            pa.array(np.concatenate([own, roots]), mask=np.concatenate([np.ones(len(own), bool), none])), np.full(len(own) + len(nodes), recall),
        ], schema=schema)

    return dealt.groupBy("dim", "shard", "block").cogroup(queries.groupBy("dim", "shard", "block")).applyInArrow(look_up, "id bigint, found bigint, root bigint, recall double")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row, and recall: the least that the audits of its queries found."""
    pts = common.checkpointed(points(vectors))
    shards = max(LEAST_SHARDS, -(-pts.count() // SHARD_POINTS))
    seen = common.checkpointed(links(pts, shards))
    counts = seen.where("found is not null").groupBy("id").agg(F.sum("found").alias("found"), F.min("recall").alias("recall"))
    roots = components(seen.where("root is not null").select("id", "root"), "id", "root")
    about = pts.join(counts, "id", "left").join(roots, pts["id"] == roots["node"], "left").select("embedding", (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("component"), "recall")
    out = vectors.select("vec_id", "embedding").join(about, "embedding", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("bigint").alias("n_links"), F.when(F.col("vec_id").isNotNull(), component).alias("component_id"), (F.col("vec_id") == component).alias("kept"), "recall")


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "embeddings"))
