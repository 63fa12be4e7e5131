"""The stages one after the other, and each against a plain version on the small tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, minhash, mixing, pii, toxicity


def test_stages_and_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf_dir)
        assert out.columns == docs.columns, name
        kept = spark.createDataFrame(out.collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert last.columns == ["doc_id", "ids"] and last.count() == kept.count()


def test_run_equals_the_stages_by_hand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [r for r in docs.collect() if model.score(r["text"]) < 0.5]
    fine = spark.createDataFrame(rows, docs.schema)
    alone = {r["doc_id"] for r in minhash.near_duplicates(fine).where("kept").collect()}
    encode = bpe.load(bpe.vocabulary()).encode
    import struct

    want = {}
    for r in rows:
        if r["doc_id"] in alone:
            ids = encode(pii.redacted(r["text"]))
            want[r["doc_id"]] = list(struct.unpack(f"<{len(ids) // 4}I", ids))
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and len(got) > 100


def test_the_mix_reaches_the_result(spark, sf_dir):
    """Rows come in order of slots, and no source is a whole block off its target weight."""
    sources = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert [(r["slot"], r["doc_id"]) for r in rows] == sorted((r["slot"], r["doc_id"]) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(sources[r["doc_id"]], []).append(r["slot"])
    most = max(map(len, by.values()))
    parts = {s: max(1, int(100 * (len(x) / most) ** 0.5 + 0.5)) for s, x in by.items()}
    q = sum(parts.values())
    assert len(by) > 1 and sum(len(set(x)) for x in by.values()) == len({r["slot"] for r in rows})
    for s, x in by.items():
        assert max(x.count(t) for t in set(x)) <= mixing.BLOCK_ROWS
        for k, t in enumerate(sorted(set(x))):
            assert k * q // parts[s] <= t < -(-(k + 1) * q // parts[s])


def test_the_mix_decides_the_order(spark, docs_of, tmp_path, monkeypatch):
    """Another mix gives other slots and another order, in run and stage by stage through files."""
    docs_of([f"text number {i} of its own kind {i * i}" for i in range(600)], source=["abc"[i % 3] for i in range(600)]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")

    def backwards(spark, docs, sf_dir):
        rows = docs.withColumn("at", 1_000 - F.col("doc_id")).repartitionByRange(5, "at").sortWithinPartitions("at")
        return rows.select(*[F.col("at").alias("slot") if c == "slot" else F.col(c) for c in docs.columns])

    chain = [("mixing", backwards), ("bpe", bpe.stage)]
    monkeypatch.setattr(corpus_pipeline, "STAGES", chain)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [(r["doc_id"], r["slot"]) for r in rows] == [(i, 1_000 - i) for i in reversed(range(600))]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for mix, name in ((backwards, "a"), (mixing.stage, "b")):
        mix(spark, docs, "").write.parquet(f"{tmp_path}/{name}")
        got = [r["doc_id"] for r in bpe.stage(spark, spark.read.parquet(f"{tmp_path}/{name}"), "").collect()]
        slots = {r["doc_id"]: r["_slot"] for r in mixing.mix(docs).collect()}
        assert got == sorted(slots, key=(lambda i: -i) if name == "a" else lambda i: (slots[i], i))


@pytest.mark.parametrize("stage", [minhash.stage, pii.stage, mixing.stage, bpe.stage])
def test_stages_on_odd_rows(spark, sf_dir, docs_of, stage):
    docs = docs_of([None, "", "same text here again", "same text here again", "x " * 50_000])
    assert stage(spark, docs, sf_dir).count() == (4 if stage is minhash.stage else 5)
    assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_toxic_documents_go(spark, docs_of):
    docs = docs_of([f"some words {i} and more of them" + (" you idiot moron" if i % 4 == 0 else "") for i in range(400)])
    labels = docs.selectExpr("doc_id", "1 AS quality", "cast(doc_id % 4 = 0 AS int) AS toxic")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).toPandas()
    assert (got["predicted"] == (got["doc_id"] % 4 == 0)).mean() > 0.99
