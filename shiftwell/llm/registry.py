"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from . import bpe, chat, decontaminate, langid, neardup, quality, rules, substring, toxicity, urlfilter

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_quality_rules": rules.op4_quality_rules,
    "op5_substring_dedup": substring.op5_substring_dedup,
    "op6_url_filter": urlfilter.op6_url_filter,
    "op7_bpe": bpe.op7_bpe,
    "op8_chat": chat.op8_chat,
    "op9_langid": langid.op9_langid,
    "op10_simhash": neardup.op10_simhash,
}
#: The others have no SQL form: fitted models, XXH64, BPE.
ORACLE: dict[str, str] = {
    "op3_decontamination": decontaminate.ORACLE_SQL,
    "op5_substring_dedup": substring.ORACLE_SQL,
    "op6_url_filter": urlfilter.ORACLE_SQL,
    "op8_chat": chat.ORACLE_SQL,
}
