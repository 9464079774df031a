"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from foliate.llm import exact_dedup, fingerprints, lm, mixing, packing, pii, quality, simhash, substrings, toxicity

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_substrings": substrings.op3_substrings,
    "op4_simhash": simhash.op4_simhash,
    "op5_quality": quality.op5_quality,
    "op6_mixing": mixing.op6_mixing,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_pii": pii.op8_pii,
    "op9_packing": packing.op9_packing,
    "op10_lm": lm.op10_lm,
}

ORACLES = {"op7_exact_dedup": exact_dedup.ORACLE}
