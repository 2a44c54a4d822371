"""Queries of this subpackage and their SQL oracles."""

from __future__ import annotations

from tidemark.llm import bpe, chat_format, exact_dedup, language_id, line_dedup, lm_score, merkle, minhash, packing, quality_knn, quality_rules, resampling, toxicity


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_near_dedup": minhash.op3_near_dedup,
        "op4_lm_score": lm_score.op4_lm_score,
        "op5_chat_format": chat_format.op5_chat_format,
        "op6_quality": quality_knn.op6_quality,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_bpe": bpe.op8_bpe,
        "op9_language_id": language_id.op9_language_id,
        "op10_packing": packing.op10_packing,
        "op11_line_dedup": line_dedup.op11_line_dedup,
        "op12_resampling": resampling.op12_resampling,
        "op13_merkle": merkle.op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.ORACLE, "op5_chat_format": chat_format.ORACLE, "op11_line_dedup": line_dedup.ORACLE, "op12_resampling": resampling.ORACLE, "op13_merkle": merkle.ORACLE}
