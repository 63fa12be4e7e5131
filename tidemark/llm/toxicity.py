"""Toxicity by non-negative positive-unlabelled (nnPU) learning.

Confirmed toxic examples are the positives; any other text is unlabelled, since a missing label says
nothing. With the class prior p, the risk of a scorer g under the loss l is

    p * E_pos[l(g, +1)] + max(0, E_unl[l(g, -1)] - p * E_pos[l(g, -1)])

where the second term estimates the risk on the negatives, which nobody marked, and is kept from going
below zero (which is where an overfitted scorer would push it). Several linear scorers in numpy are
trained from different seeds and their probabilities averaged. Features are the distinct words of the
whole text, so a word counts alike in a short and in a very long text.

Fixed bounds, documented parameters: MAX_POSITIVE and MAX_UNLABELLED documents in training and
MAX_FEATURES words in the model. Scoring reads every document.

Defined results: null and empty texts have no words and get the score of the bias alone; without any
positive example every score is 0.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES = 2500, 8000, 2048
#: EPOCHS and DECAY were chosen by cross-validation among the learning folds; no held-out label had a part in it.
SEEDS, EPOCHS, BATCH, RATE, DECAY = (1, 2, 3), 10, 512, 0.02, 1e-5
MIN_DOCS, MIN_Z = 5, 4.0
_WORD = re.compile(r"[^\W_]+")


def word_ids(text: str | None) -> np.ndarray:
    """Sorted 32-bit ids of the distinct lower-case words of a text."""
    return np.array(sorted({zlib.crc32(w.encode()) for w in set(_WORD.findall((text or "").lower()))}), np.uint32)


@dataclass
class Model:
    words: np.ndarray  # sorted ids
    weights: np.ndarray  # scorers x words
    biases: np.ndarray

    def score(self, text: str | None) -> float:
        ids = word_ids(text)
        at = np.searchsorted(self.words, ids) if len(self.words) else np.zeros(0, int)
        hit = at[at < len(self.words)]
        hit = hit[self.words[hit] == ids[at < len(self.words)]]
        g = self.weights[:, hit].sum(axis=1) + self.biases
        return float((1 / (1 + np.exp(-np.clip(g, -30, 30)))).mean())


NEVER = Model(np.zeros(0, np.uint32), np.zeros((1, 0)), np.array([-40.0]))


def nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, seed: int) -> tuple[np.ndarray, float]:
    """A linear scorer that minimises the non-negative risk under the sigmoid loss, by Adam in mini-batches.

    That loss is flat far from the border, so it starts from the log odds of each word among the positives and, with
    the positives' share taken out of the unlabelled, among the negatives. Absent words say nothing at the start: they
    go together, and counted one by one they would outweigh any word that is there.
    """
    rng = np.random.default_rng(seed)
    p = np.clip(pos.mean(axis=0), 1e-3, 1 - 1e-3)
    n = np.clip((unl.mean(axis=0) - prior * p) / (1 - prior), 1e-3, 1 - 1e-3)
    theta = np.append(np.log(p / n), np.log(prior / (1 - prior))) + rng.normal(0, 0.01, pos.shape[1] + 1)
    m, v, step = np.zeros_like(theta), np.zeros_like(theta), 0
    pos, unl = (np.hstack([x, np.ones((len(x), 1), np.float32)]) for x in (pos, unl))

    def loss(x: np.ndarray, sign: int) -> tuple[float, np.ndarray]:
        s = 1 / (1 + np.exp(np.clip(sign * (x @ theta), -30, 30)))  # small where g has the wanted sign
        return s.mean(), (x * (-sign * s * (1 - s))[:, None]).mean(axis=0)

    batches = max(1, len(unl) // BATCH)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(unl)), batches):
            some = pos[rng.choice(len(pos), min(len(pos), BATCH), replace=False)]
            _, up = loss(some, 1)
            as_neg, up_neg = loss(some, -1)
            unl_neg, un = loss(unl[part], -1)
            short = unl_neg - prior * as_neg  # the risk on negatives, estimated
            grad = prior * up + un - prior * up_neg if short >= 0 else prior * up_neg - un
            grad = grad + DECAY * np.append(theta[:-1], 0)
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit(pos: list[np.ndarray], unl: list[np.ndarray], prior: float) -> Model:
    """From the word ids of positive and unlabelled texts; the words that differ most between the two are the features."""
    if not pos or not unl:
        return NEVER
    ids, where = np.unique(np.concatenate([*pos, *unl]), return_inverse=True)
    cut = sum(map(len, pos))
    a, b = np.bincount(where[:cut], minlength=len(ids)), np.bincount(where[cut:], minlength=len(ids))
    pa_, pb = a / len(pos), b / len(unl)
    mean = (a + b) / (len(pos) + len(unl))
    z = np.abs(pa_ - pb) / np.sqrt(mean * (1 - mean) * (1 / len(pos) + 1 / len(unl)) + 1e-12)
    z[a + b < min(MIN_DOCS, len(pos))] = 0
    best = np.argsort(-z, kind="stable")[:MAX_FEATURES]
    words = np.sort(ids[best[z[best] >= MIN_Z]])

    def matrix(docs: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(docs), len(words)), np.float32)
        for i, d in enumerate(docs):
            x[i, np.isin(words, d, assume_unique=True)] = 1
        return x

    x, u = matrix(pos), matrix(unl)
    scorers = [nnpu(x, u, prior, seed) for seed in SEEDS]
    return Model(words, np.array([w for w, _ in scorers]), np.array([b for _, b in scorers]))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> Model:
    """Learns from rows outside the held-out fold; the class prior is the share of toxic rows among its labels."""
    known = common.label_of(labels, "toxic").where(common.fold(F.col("doc_id"), folds) != held)
    seen = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if not seen.get(1):
        return NEVER
    prior = min(0.5, max(0.01, seen[1] / sum(seen.values())))
    positive = common.bounded_sample(known.where("label = 1"), "label", MAX_POSITIVE).select("doc_id", F.lit(True).alias("is_positive"))
    rest = docs.select("doc_id", "text", F.lit(0).alias("all_rows")).where(common.fold(F.col("doc_id"), folds) != held)
    unlabelled = common.bounded_sample(rest, "all_rows", MAX_UNLABELLED).select("text", F.lit(False).alias("is_positive"))
    chosen = rest.join(F.broadcast(positive), "doc_id").select("text", "is_positive").unionByName(unlabelled)

    def work(batches):
        for b in batches:
            yield pa.record_batch([b.column(1), pa.array([word_ids(t).tobytes() for t in b.column(0).to_pylist()], pa.binary())], names=["is_positive", "ids"])

    got = common.map_batches(chosen, work, "is_positive boolean, ids binary").toArrow()
    rows = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))  # the order of tasks must not matter
    ids = {kind: [np.frombuffer(x, np.uint32) for k, x in rows if k is kind] for kind in (True, False)}
    return fit(ids[True], ids[False], prior)


def score(docs: DataFrame, model: Model, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows = docs.select("doc_id", "text", (common.fold(F.col("doc_id"), folds) == held).alias("held_out"))

    def work(batches):
        for b in batches:
            s = [model.score(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return common.map_batches(rows, work, "doc_id bigint, held_out boolean, score double, predicted int")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return score(docs, train(docs, common.read(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the model doesn't call toxic, unchanged."""
    model = train(docs, common.read(spark, sf_dir, "labels"))
    return common.keep_rows(docs, lambda texts: [model.score(t) < 0.5 for t in texts])
