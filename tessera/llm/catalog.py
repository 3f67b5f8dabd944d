"""Registered queries of this subpackage: name → (Spark builder, DuckDB oracle or None)."""

from __future__ import annotations

from . import backoff_lm, dart_minhash, exact_dedup, factorization, hard_negatives, merkle, mixing, pieces, repetition, secrets, substring_dedup, toxicity, url_filter

REGISTRY = {
    "op1_dart_minhash": (dart_minhash.op1_dart_minhash, None),
    "op2_exact_dedup": (exact_dedup.op2_exact_dedup, exact_dedup.ORACLE),
    "op3_factorization": (factorization.op3_factorization, None),
    "op4_substring_dedup": (substring_dedup.op4_substring_dedup, None),
    "op5_mixing": (mixing.op5_mixing, mixing.ORACLE),
    "op6_pieces": (pieces.op6_pieces, None),
    "op7_secrets": (secrets.op7_secrets, None),
    "op8_backoff_lm": (backoff_lm.op8_backoff_lm, backoff_lm.ORACLE),
    "op9_repetition": (repetition.op9_repetition, None),
    "op10_url_filter": (url_filter.op10_url_filter, url_filter.ORACLE),
    "op11_merkle": (merkle.op11_merkle, merkle.ORACLE),
    "op12_toxicity": (toxicity.op12_toxicity, None),
    "op13_hard_negatives": (hard_negatives.op13_hard_negatives, hard_negatives.ORACLE),
}
