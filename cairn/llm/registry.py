"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, chat, credentials, decontaminate, html, importance, jaccard, language, lines, negatives, private, quality, repeats

QUERIES = {
    "op1_chat_formatting": chat.query,
    "op2_decontamination": decontaminate.query,
    "op3_quality_rules": quality.query,
    "op4_byte_bpe": bpe.query,
    "op5_suffix_dedup": repeats.query,
    "op6_ngram_jaccard_join": jaccard.query,
    "op7_language_id": language.query,
    "op8_private_data": private.query,
    "op9_html_extraction": html.query,
    "op10_line_dedup": lines.query,
    "op11_secret_scan": credentials.query,
    "op12_hard_negatives": negatives.query,
    "op13_importance_resampling": importance.query,
}
SQL = {
    "op1_chat_formatting": chat.SQL,
    "op2_decontamination": decontaminate.SQL,
    "op6_ngram_jaccard_join": jaccard.SQL,
    "op10_line_dedup": lines.SQL,
    "op11_secret_scan": credentials.SQL,
    "op12_hard_negatives": negatives.SQL,
    "op13_importance_resampling": importance.SQL,
}
