"""Queries and SQL of this subpackage."""

from __future__ import annotations

from lorewell.llm import chat, decontamination, fingerprints, language, licenses, near_dedup, packing, pii, quality, repeats, resampling, token_output, whitening

QUERIES = {"op1_quality": quality.query, "op8_decontamination": decontamination.query, "op2_token_output": token_output.query, "op3_repeats": repeats.query, "op4_fingerprints": fingerprints.query, "op5_licenses": licenses.query, "op6_language": language.query, "op7_near_dedup": near_dedup.query, "op9_packing": packing.query, "op10_chat_format": chat.query, "op11_resampling": resampling.query, "op12_pii": pii.query, "op13_whitening": whitening.query}
SQL = {"op10_chat_format": chat.SQL, "op11_resampling": resampling.SQL}
