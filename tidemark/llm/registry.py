"""The queries of this package, and their SQL where there is any."""

from __future__ import annotations

from . import bpe, embeddings, langid, minhash, mixing, pii, quality_cnn, quality_rules, substrings, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_bpe": bpe.op2_bpe,
    "op3_pii": pii.op3_pii,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_embeddings": embeddings.op5_embeddings,
    "op6_language_id": langid.op6_language_id,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_quality": quality_cnn.op8_quality,
    "op9_minhash": minhash.op9_minhash,
    "op10_mixing": mixing.op10_mixing,
}
ORACLES: dict[str, str] = {
    "op4_substring_dedup": substrings.OP4_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
    "op9_minhash": minhash.OP9_SQL,
    "op10_mixing": mixing.OP10_SQL,
}
