"""Quality by a byte-level convolutional network in numpy.

Learned filters of WIDTH bytes run over the whole document, cut into chunks of CHUNK bytes that overlap by
WIDTH - 1; each filter's largest response in a chunk is kept, and the maximum and the mean over a document's
chunks are combined into one probability. Byte values are looked up two at a time, so a filter costs WIDTH / 2
additions a byte.

Fixed bounds, documented parameters: PER_CLASS training documents a class, FILTERS filters. Every document is
scored over all its bytes, with memory bounded by BLOCK bytes.

Defined results: null and empty texts are one chunk of zero bytes; without labels of both classes, every score
is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PER_CLASS, FILTERS, WIDTH, CHUNK, BLOCK, EPOCHS, RATE = 1200, 16, 6, 512, 1 << 15, 8, 0.01


def padded(text: str | None) -> np.ndarray:
    """The text's bytes, with zeros to a whole number of chunks, and WIDTH more for the last windows."""
    b = (text or "").encode("utf-8", "replace")
    return np.frombuffer(b + bytes(-len(b) % CHUNK if b else CHUNK), np.uint8)


@dataclass
class Network:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    top: np.ndarray  # 2 FILTERS + 1: of the maximum, of the mean, and the constant

    def tables(self) -> list[np.ndarray]:
        """Responses by pairs of bytes."""
        w = self.filters
        return [(w[j][:, None, :] + w[j + 1][None, :, :]).reshape(65536, -1).astype(np.float32) for j in range(0, WIDTH, 2)]

    def chunks(self, b: np.ndarray, tables: list[np.ndarray], where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each filter's largest response in each chunk of padded bytes, and its place."""
        tops, places = [], []
        for at in range(0, len(b), BLOCK):
            part = b[at : at + BLOCK + WIDTH]
            n = min(BLOCK, len(b) - at)
            part = np.concatenate([part, np.zeros(n + WIDTH - len(part), np.uint8)]) if len(part) < n + WIDTH else part
            pair = part[:-1].astype(np.uint16) << 8 | part[1:]
            x = tables[0].take(pair[:n], axis=0)
            for j in range(1, len(tables)):
                x += tables[j].take(pair[2 * j : 2 * j + n], axis=0)
            x = x.reshape(-1, CHUNK, x.shape[1])
            tops.append(x.max(axis=1))
            if where:
                places.append(x.argmax(axis=1) + at + CHUNK * np.arange(len(x))[:, None])
        return np.concatenate(tops) + self.bias, np.concatenate(places) if where else None

    def logits(self, top: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of documents that have so many of the chunks each; and what the last layer sees."""
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        act = np.tanh(top)
        seen = np.hstack([np.maximum.reduceat(act, starts), np.add.reduceat(act, starts) / counts[:, None], np.ones((len(counts), 1))])
        return seen @ self.top, seen

    def scores(self, texts: list[str | None], tables: list[np.ndarray]) -> np.ndarray:
        tops = [self.chunks(padded(t), tables)[0] for t in texts]
        if not tops:
            return np.zeros(0)
        logit, _ = self.logits(np.concatenate(tops), np.array([len(t) for t in tops]))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def constant(p: float) -> Network:
    top = np.zeros(2 * FILTERS + 1)
    top[-1] = np.log(p / (1 - p)) if 0 < p < 1 else (40.0 if p >= 1 else -40.0)
    return Network(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS), top)


def fit(texts: list[str], labels: list[int], seed: int = 3) -> Network:
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return constant(y.mean() if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.15, (WIDTH, 256, FILTERS)), np.zeros(FILTERS), np.append(rng.normal(0, 0.3, 2 * FILTERS), 0.0))
    docs = [padded(t) for t in texts]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.filters, net.bias, net.top)]
    step = 0
    for epoch in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // 24)):
            b, counts = np.concatenate([np.concatenate([docs[i], np.zeros(CHUNK, np.uint8)]) for i in part]), np.array([len(docs[i]) // CHUNK for i in part])
            top, places = net.chunks(b, net.tables(), where=True)
            own = np.concatenate([np.append(np.ones(c, bool), False) for c in counts])  # not the gaps between documents
            top, places = top[own], places[own]
            logit, seen = net.logits(top, counts)
            d = (1 / (1 + np.exp(-logit)) - y[part]) * weight[part] / len(part)
            act, doc = np.tanh(top), np.repeat(np.arange(len(part)), counts)
            d_act = d[doc, None] * net.top[None, FILTERS : 2 * FILTERS] / counts[doc, None] + np.where(act == seen[doc, :FILTERS], d[doc, None] * net.top[None, :FILTERS], 0)
            d_top = d_act * (1 - act**2)
            grad = np.zeros_like(net.filters)
            at = np.concatenate([b, np.zeros(WIDTH, np.uint8)])
            for j in range(WIDTH):
                np.add.at(grad[j], (at[places + j], np.arange(FILTERS)[None, :]), d_top)
            step += 1
            for p, g, s in zip((net.filters, net.bias, net.top), (grad + 1e-5 * net.filters, d_top.sum(axis=0), seen.T @ d + 1e-4 * net.top), state, strict=True):
                s[0] = 0.9 * s[0] + 0.1 * g
                s[1] = 0.999 * s[1] + 0.001 * g**2
                p -= RATE * (1 - epoch / EPOCHS) * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8)
    net.filters = net.filters.astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> Network:
    known = common.label_of(labels, "quality").where(common.fold(F.col("doc_id"), folds) != held)
    chosen = common.bounded_sample(known, "label", PER_CLASS)
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", F.coalesce("text", F.lit("")).alias("text")).toArrow()
    rows = sorted(zip(*(c.to_pylist() for c in got.columns), strict=True))
    return fit([t for _, t in rows], [int(x) for x, _ in rows])


def score(docs: DataFrame, net: Network, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows = docs.select("doc_id", "text", (common.fold(F.col("doc_id"), folds) == held).alias("held_out"))

    def work(batches):
        tables = net.tables()
        for b in batches:
            s = net.scores(b.column(1).to_pylist(), tables)
            yield pa.record_batch([b.column(0), b.column(2), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return common.map_batches(rows, work, "doc_id bigint, held_out boolean, score double, predicted int")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return score(docs, train(docs, common.read(spark, sf_dir, "labels")))
