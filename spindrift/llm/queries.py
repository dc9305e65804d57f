"""The named queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from spindrift.llm import exact, golay, mixing, packing, pii, quality, secrets, simhash, toxicity, urls

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_exact_dedup": exact.op3_exact_dedup,
    "op4_url_filter": urls.op4_url_filter,
    "op5_secrets": secrets.op5_secrets,
    "op6_pii": pii.op6_pii,
    "op7_quality": quality.op7_quality,
    "op8_simhash": simhash.op8_simhash,
    "op9_packing": packing.op9_packing,
    "op10_simhash_neardup": golay.op10_simhash_neardup,
}

ORACLE_SQL = {
    "op3_exact_dedup": exact.OP3_SQL,
}
