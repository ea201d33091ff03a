"""The corpus operators' queries and SQL, by name."""

from __future__ import annotations

from tessera.llm import chat, language, licences, media, mixing, neardup, pieces, quality, substring, topk

_ALL = {
    "op1_jaccard_join": neardup,
    "op2_language_id": language,
    "op3_media_columns": media,
    "op4_mixing_balance": mixing,
    "op5_substring_dedup": substring,
    "op6_chat_format": chat,
    "op7_quality_gam": quality,
    "op8_exact_topk": topk,
    "op9_licence_scan": licences,
    "op10_sentencepiece": pieces,
}


def queries() -> dict:
    return {name: module.query for name, module in _ALL.items()}


def oracle_sql() -> dict:
    return {name: module.SQL for name, module in _ALL.items() if module.SQL}
