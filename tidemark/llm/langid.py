"""Language identification in two levels.

A linear model first predicts the language family; inside a family, one-versus-one linear support vector
machines separate the languages and vote. Features are counts of hashed byte trigrams of the lower-case
text, with everything that isn't a letter read as a space, square-rooted and scaled to unit length.

Fixed bounds, documented parameters: PER_LANGUAGE training documents of each language and BUCKETS hash
buckets. Prediction reads every document.

Defined results: a null text, or one without a letter, is `und` with score 0, as is every text when nothing
could be learned. With one learned language, that one is predicted with score 1.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PER_LANGUAGE, BUCKETS, EPOCHS, LAMBDA = 1000, 4096, 25, 1e-4
#: Families by ISO 639-1 code; a language that isn't here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "semitic": "ar he mt am",
    "indic": "hi ur bn mr gu pa ne",
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
_LETTER = re.compile(r"[^\W\d_]")
_LETTERS_ONLY = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def features(texts: list[str | None]) -> np.ndarray:
    """A row of BUCKETS for each text."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for i, text in enumerate(texts):
        b = np.frombuffer(b" " + (text or "").lower().encode("utf-8", "replace").translate(_LETTERS_ONLY) + b" ", np.uint8).astype(np.uint32)
        gap = b == 32
        b = b[~(gap & np.concatenate([[False], gap[:-1]]))]  # one space for a run
        if len(b) >= 3:
            h = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(20)
            x = np.sqrt(np.bincount(h, minlength=BUCKETS))
            out[i] = x / np.linalg.norm(x)
    return out


def svm(x: np.ndarray, y: np.ndarray, seed: int = 5) -> np.ndarray:
    """Weights and, last, the bias of a linear support vector machine: hinge loss, averaged stochastic subgradients."""
    rng, x = np.random.default_rng(seed), np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, mean, n = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)  # classes count alike
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            n += 1
            bad = part[y[part] * (x[part] @ w) < 1]
            w = w * (1 - 1 / (n + 10)) + (x[bad] * (y[bad] * weight[bad])[:, None]).sum(axis=0) / (len(part) * LAMBDA * 1000 * (1 + n / 50))
            mean += (w - mean) / n
    return mean.astype(np.float32)


@dataclass
class Model:
    families: list[str]
    by_family: np.ndarray  # BUCKETS + 1 x families
    members: dict[str, list[str]]
    pairs: dict[tuple[str, str], np.ndarray]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        x = np.hstack([features(texts), np.ones((len(texts), 1), np.float32)])
        sure = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -8, 8)))  # noqa: E731  of a margin
        first = x @ self.by_family if len(self.families) > 1 else None
        votes = {p: x @ w for p, w in self.pairs.items()}
        out = []
        for i, text in enumerate(texts):
            if not self.families or not _LETTER.search(text or ""):
                out.append(("und", 0.0))
                continue
            k = int(first[i].argmax()) if first is not None else 0
            family, p = self.families[k], float(sure(first[i][k])) if first is not None else 1.0
            langs = self.members[family]
            won = {a: [0, 0.0] for a in langs}
            for a, b in combinations(langs, 2):
                m = float(votes[a, b][i])
                won[a if m >= 0 else b][0] += 1
                won[a][1] += m
                won[b][1] -= m
            best = max(langs, key=lambda a: (*won[a], a))
            for a in langs:
                if a != best:
                    m = votes[min(a, best), max(a, best)][i]
                    p = min(p, float(sure(m if best < a else -m)))
            out.append((best, p))
        return out


def fit(texts: list[str], langs: list[str]) -> Model:
    names = sorted(set(langs))
    members: dict[str, list[str]] = {}
    for n in names:
        members.setdefault(FAMILY.get(n, n), []).append(n)
    families, x, lang = sorted(members), features(texts), np.array(langs)
    family = np.array([FAMILY.get(n, n) for n in langs])
    tops = [svm(x, np.where(family == f, 1, -1)) for f in families] if len(families) > 1 else []
    pairs = {}
    for own in members.values():
        for a, b in combinations(own, 2):
            rows = (lang == a) | (lang == b)
            pairs[a, b] = svm(x[rows], np.where(lang[rows] == a, 1, -1))
    return Model(families, np.array(tops).T if tops else np.zeros((BUCKETS + 1, 0)), members, pairs)


def train(docs: DataFrame, folds: int = 4, held: int = 2) -> Model:
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (common.fold(F.col("doc_id"), folds) != held))
    got = sorted(zip(*(c.to_pylist() for c in common.bounded_sample(known, "lang", PER_LANGUAGE).select("lang", "text").toArrow().columns), strict=True))
    return fit([t for _, t in got], [n for n, _ in got])


def predict(docs: DataFrame, model: Model, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    rows = docs.select("doc_id", "text", (common.fold(F.col("doc_id"), folds) == held).alias("held_out"))

    def work(batches):
        for b in batches:
            got = model.predict(b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), b.column(2), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return common.map_batches(rows, work, "doc_id bigint, held_out boolean, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return predict(docs, train(docs))
