"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, conversations, exact_dedup, language, lexical, mixing, near_dedup, pii, quality, quality_classifier, substring_dedup, toxicity

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_chat_format": chat.query,
    "op3_toxicity": toxicity.query,
    "op4_language": language.query,
    "op5_pii": pii.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_near_dedup": near_dedup.query,
    "op8_mixing": mixing.query,
    "op9_quality": quality.query,
    "op10_bpe": bpe.query,
    "op11_quality_classifier": quality_classifier.query,
    "op12_conversation_repair": conversations.query,
    "op13_lexical_search": lexical.query,
}

SQL = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op2_chat_format": chat.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op7_near_dedup": near_dedup.SQL,
    "op8_mixing": mixing.SQL,
    "op12_conversation_repair": conversations.SQL,
    "op13_lexical_search": lexical.SQL,
}
