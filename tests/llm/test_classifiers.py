"""Toxicity, language and quality: held-out accuracy on the small tables, and odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, langid, quality_cnn, toxicity

ODD = [None, "", " \n", "idiot " * 30_000, "1234 !!", "x"]


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


def test_fold_is_crc32_of_the_id_as_text(spark):
    import zlib

    got = spark.range(50).select("id", common.fold(F.col("id"), 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)


def test_bounded_sample_is_bounded(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 100 == 0).cast("int").alias("g"))
    n = {r["g"]: r["count"] for r in common.bounded_sample(rows, "g", 500).groupBy("g").count().collect()}
    assert n[1] == 200 and 400 < n[0] < 600
    assert common.bounded_sample(rows.limit(0), "g", 5).count() == 0


def test_nnpu_finds_the_positives_among_the_unlabelled():
    rng = np.random.default_rng(0)
    pos = (rng.random((300, 20)) < 0.3).astype(np.float32)
    pos[:, 0] = 1
    unl = (rng.random((2000, 20)) < 0.3).astype(np.float32)
    unl[:, 0] = np.arange(2000) < 200
    w, b = toxicity.nnpu(pos, unl, 0.1, 1)
    assert ((unl @ w + b > 0) == (unl[:, 0] == 1)).mean() > 0.97


def test_toxicity_held_out(spark, larger):
    got = toxicity.op1_toxicity(spark, larger).join(common.read(spark, larger, "labels"), "doc_id").where("held_out").toPandas()
    assert got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= 0.5)).all()
    clean = got[got["toxic"] == 0]
    assert (clean["predicted"] == 0).mean() > 0.98
    insulting = common.read(spark, larger, "documents").where("lower(text) rlike 'idiot|moron|stupid|worthless'").select("doc_id").toPandas()["doc_id"]
    caught = got[(got["toxic"] == 1) & got["doc_id"].isin(insulting)]
    assert (caught["predicted"] == 1).mean() > 0.9


def test_quality_held_out(spark, larger):
    got = quality_cnn.op8_quality(spark, larger).join(common.read(spark, larger, "labels"), "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.93


def test_language_held_out(spark, larger):
    got = langid.op6_language_id(spark, larger).join(common.read(spark, larger, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97


@pytest.mark.parametrize("make", [lambda d: toxicity.score(d, toxicity.NEVER), lambda d: langid.predict(d, langid.fit([], [])), lambda d: quality_cnn.score(d, quality_cnn.fit([], []))])
def test_odd_rows_and_nothing_learned(docs_of, make):
    docs = docs_of(ODD)
    assert make(docs).count() == len(ODD)
    assert make(docs.limit(0)).count() == 0
    assert all(0 <= r["score"] <= 1 for r in make(docs).collect())


def test_languages_without_letters_are_unknown(docs_of):
    m = langid.fit(["the cat", "der hund", "le chat", "el gato"] * 5, ["en", "de", "fr", "es"] * 5)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs_of(ODD), m).collect()}
    assert [got[i] for i in (0, 1, 2, 4)] == ["und"] * 4 and got[3] in ("en", "de", "fr", "es")


def test_untrained_tables(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.train(docs_of(ODD), labels) is toxicity.NEVER
    assert quality_cnn.train(docs_of(ODD), labels).top[-1] == 0.0


def test_network_sees_every_byte():
    """A text's score doesn't depend on what it is scored with, and its last bytes count."""
    net = quality_cnn.fit(["good words here"] * 20 + ["$$$ ### junk"] * 20, [1] * 20 + [0] * 20)
    long = "good words here " * 5000
    texts = ["good words", long, "", long + "$$$ ### junk", None, "x" * quality_cnn.CHUNK, "x" * (quality_cnn.BLOCK + 3)]
    tables = net.tables()
    alone = [net.scores([t], tables)[0] for t in texts]
    assert np.allclose(net.scores(texts, tables), alone)
    assert alone[3] < alone[1] and alone[2] == alone[4]


def test_filters_by_brute_force():
    net = quality_cnn.Network(np.random.default_rng(1).normal(0, 1, (quality_cnn.WIDTH, 256, quality_cnn.FILTERS)).astype(np.float32), np.zeros(quality_cnn.FILTERS), np.zeros(2 * quality_cnn.FILTERS + 1))
    b = quality_cnn.padded("abc é " * 200)
    full = np.concatenate([b, np.zeros(quality_cnn.WIDTH, np.uint8)])
    each = np.array([sum(net.filters[j, full[i + j]] for j in range(quality_cnn.WIDTH)) for i in range(len(b))])
    assert np.allclose(net.chunks(b, net.tables())[0], each.reshape(-1, quality_cnn.CHUNK, quality_cnn.FILTERS).max(axis=1), atol=1e-4)
