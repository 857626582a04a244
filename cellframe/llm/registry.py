"""The corpus operators' queries for __spark_entry__.py."""

from __future__ import annotations

from . import decontaminate, embedjoin, html, jaccard, langid, mixing, prefixtrie, quality, spelling, suffixdedup, tokenfiles, tokens, urls

_OPS = {
    "op1_url_filters": urls,
    "op2_token_counts": tokens,
    "op3_quality_rules": quality,
    "op4_token_files": tokenfiles,
    "op5_suffix_array_dedup": suffixdedup,
    "op6_mixing": mixing,
    "op7_html_extraction": html,
    "op8_ngram_jaccard": jaccard,
    "op9_language_id": langid,
    "op10_decontamination": decontaminate,
    "op11_embedding_near_dedup": embedjoin,
    "op12_conversation_trie": prefixtrie,
    "op13_spelling_variants": spelling,
}


def queries():
    return {name: m.query for name, m in _OPS.items()}


def oracle_sql():
    return {name: m.SQL for name, m in _OPS.items() if hasattr(m, "SQL")}
