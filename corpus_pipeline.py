"""From raw documents to token ids in five stages, each written as Parquet and read again by the next.

Toxic documents go, one document of each near-duplicate group stays, personal data is replaced, the sources are
mixed to their target weights, and the texts become token ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, minhash, mixing, pii, toxicity

STAGES = [
    ("toxicity", toxicity.stage),
    ("minhash", minhash.stage),
    ("pii", pii.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]

#: A trained classifier, hashed minima and a tokenizer have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each from what the last one wrote to the shared checkpoint folder. The documents carry a `slot`, empty until the mix fills it, by which the ids are ordered."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    between = f"{shared}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("slot", F.lit(None).cast("bigint"))
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{between}/{i}-{name}")
            docs = spark.read.parquet(f"{between}/{i}-{name}")
    return docs
