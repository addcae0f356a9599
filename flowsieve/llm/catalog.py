"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from flowsieve.llm import conversations, decontaminate, fingerprints, html, jaccard, language, packing, pii, quality, scoring, toxicity, urls, whitening

QUERIES = {
    "op1_lm_scoring": scoring.op1_lm_scoring,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_pii": pii.op3_pii,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_language_id": language.op6_language_id,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_html_extraction": html.op8_html_extraction,
    "op9_url_filter": urls.op9_url_filter,
    "op10_packing": packing.op10_packing,
    "op11_quality": quality.op11_quality,
    "op12_whitening": whitening.op12_whitening,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}
SQL = {"op2_decontamination": decontaminate.SQL, "op9_url_filter": urls.SQL}
