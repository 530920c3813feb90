"""The queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from sieveloom.llm import chat, decontaminate, digests, licenses, maxent, mixing, simhash, substrings, toxicity, urls

QUERIES = {
    "op1_licenses": licenses.query,
    "op2_decontamination": decontaminate.query,
    "op3_simhash": simhash.query,
    "op4_fingerprints": digests.query,
    "op5_toxicity": toxicity.query,
    "op6_chat": chat.query,
    "op7_mixing": mixing.query,
    "op8_urls": urls.query,
    "op9_substrings": substrings.query,
    "op10_lm_scores": maxent.query,
}

ORACLES = {
    "op3_simhash": simhash.ORACLE,
    "op4_fingerprints": digests.ORACLE,
    "op6_chat": chat.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op9_substrings": substrings.ORACLE,
}
