"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from . import embeddings, htmltext, mixing, neardup, packing, pii, quality, substrings, suffixes, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_query,
    "op2_neardup": neardup.op2_query,
    "op3_pii_surrogates": pii.op3_query,
    "op4_units": substrings.op4_query,
    "op5_packing": packing.op5_query,
    "op6_suffixes": suffixes.op6_query,
    "op7_mixing": mixing.op7_query,
    "op7_curriculum": mixing.op7_curriculum_query,
    "op8_vectors": embeddings.op8_query,
    "op8_planted": embeddings.planted_query,
    "op9_quality": quality.op9_query,
    "op9_base": quality.base_query,
    "op10_html_text": htmltext.op10_query,
}

ORACLES = {
    "op2_neardup": neardup.ORACLE_SQL,
    "op4_units": substrings.ORACLE_SQL,
    "op8_vectors": embeddings.ORACLE_SQL,
    "op8_planted": embeddings.PLANTED_SQL,
    "op7_mixing": mixing.ORACLE_SQL,
    "op9_base": quality.BASE_SQL,
}
