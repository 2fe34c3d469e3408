"""The queries of this subpackage and, where SQL can express one, its DuckDB twin."""

from __future__ import annotations

from . import op01_quality, op02_suffix, op03_tokens, op04_topk, op05_license, op06_decontaminate, op07_jaccard, op08_toxicity, op09_bpe, op10_secrets, op11_fingerprint, op12_whitening, op13_divergence

QUERIES = {
    "op1_quality_classifier": op01_quality.op1_quality_classifier,
    "op2_suffix_array_dedup": op02_suffix.op2_suffix_array_dedup,
    "op3_token_counts": op03_tokens.op3_token_counts,
    "op4_vector_topk": op04_topk.op4_vector_topk,
    "op5_license_scan": op05_license.op5_license_scan,
    "op6_decontamination": op06_decontaminate.op6_decontamination,
    "op7_jaccard_join": op07_jaccard.op7_jaccard_join,
    "op8_toxicity": op08_toxicity.op8_toxicity,
    "op9_byte_bpe": op09_bpe.op9_byte_bpe,
    "op10_secret_scan": op10_secrets.op10_secret_scan,
    "op11_fingerprints": op11_fingerprint.op11_fingerprints,
    "op12_whitening": op12_whitening.op12_whitening,
    "op13_source_divergence": op13_divergence.op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op4_vector_topk": op04_topk.SQL,
    "op6_decontamination": op06_decontaminate.SQL,
    "op13_source_divergence": op13_divergence.SQL,
}
