"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, language, mixing, neighbours, ngram_join, quality, sentence_pieces, substrings, token_counts, url_filter

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_url_filters": url_filter.op2_url_filters,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_language_id": language.op6_language_id,
    "op7_neighbours": neighbours.op7_neighbours,
    "op8_mixing": mixing.op8_mixing,
    "op10_ngram_jaccard_join": ngram_join.op10_ngram_jaccard_join,
    "op9_sentencepiece": sentence_pieces.op9_sentencepiece,
}

ORACLES = {
    "op2_url_filters": url_filter.ORACLE_SQL,
    "op3_chat_formatting": chat.ORACLE_SQL,
    "op8_mixing": mixing.ORACLE_SQL,
}
