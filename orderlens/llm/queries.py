"""Queries of this subpackage; ``__spark_entry__.py`` adds them to its own."""

from __future__ import annotations

from orderlens.llm import (
    chat, decontaminate, hash_index, language_id, lexical, near_dedup, packing, prefix_free, quality, suffix_tree_lm, token_files, warc, zone_negatives,
)


def queries() -> dict:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_token_files": token_files.op2_token_files,
        "op3_suffix_tree_scores": suffix_tree_lm.op3_suffix_tree_scores,
        "op4_language_id": language_id.op4_language_id,
        "op5_hash_index": hash_index.op5_hash_index,
        "op6_near_dedup": near_dedup.op6_near_dedup,
        "op7_prefix_free_dedup": prefix_free.op7_prefix_free_dedup,
        "op8_best_fit_packing": packing.op8_best_fit_packing,
        "op9_chat_format": chat.op9_chat_format,
        "op10_quality": quality.op10_quality,
        "op11_zone_negatives": zone_negatives.op11_zone_negatives,
        "op12_lexical_search": lexical.op12_lexical_search,
        "op13_warc": warc.op13_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": decontaminate.ORACLE,
        "op9_chat_format": chat.ORACLE,
        "op11_zone_negatives": zone_negatives.ORACLE,
        "op12_lexical_search": lexical.ORACLE,
        "op13_warc": warc.ORACLE,
    }
