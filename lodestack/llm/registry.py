"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, chat, fim, interactions, language_id, mixing, quality_lm, quality_rules, simhash, token_files, topk, toxicity, warc


def queries() -> dict:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_quality_lm": quality_lm.op2_quality_lm,
        "op3_chat": chat.op3_chat,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_topk": topk.op5_topk,
        "op6_bpe": bpe.op6_bpe,
        "op7_warc": warc.op7_warc,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_mixing": mixing.op9_mixing,
        "op10_language_id": language_id.op10_language_id,
        "op11_token_files": token_files.op11_token_files,
        "op12_fim": fim.op12_fim,
        "op13_interactions": interactions.op13_interactions,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": chat.ORACLE, "op5_topk": topk.ORACLE, "op7_warc": warc.ORACLE, "op8_quality_rules": quality_rules.ORACLE, "op12_fim": fim.ORACLE, "op13_interactions": interactions.ORACLE}
