"""The subpackage's queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from quire.llm import chat_format, context_mixing, html_text, jaccard_join, mixing, q1_quality, q4_decontamination, site_quality, toxicity, warc

QUERIES = {
    "op1_quality_rules": q1_quality.op1_quality_rules,
    "op2_toxicity": toxicity.op2_toxicity,
    "op4_decontamination": q4_decontamination.op4_decontamination,
    "op5_chat_format": chat_format.op5_chat_format,
    "op3_warc": warc.op3_warc,
    "op6_site_quality": site_quality.op6_site_quality,
    "op7_context_mixing": context_mixing.op7_context_mixing,
    "op8_html_text": html_text.op8_html_text,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_mixing": mixing.op10_mixing,
}
SQL = {
    "op1_quality_rules": q1_quality.SQL,
    "op4_decontamination": q4_decontamination.SQL,
    "op5_chat_format": chat_format.SQL,
    "op3_warc": warc.SQL,
    "op9_jaccard_join": jaccard_join.SQL,
    "op10_mixing": mixing.SQL,
}
