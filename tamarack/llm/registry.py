"""The queries of this package and the SQL that they are held against."""

from __future__ import annotations

from tamarack.llm import bpe, chat, cotrain, decontaminate, jaccard, language, mixing, periods, quality_rules, secrets, sharding, substring, whitening

QUERIES = {
    "op1_language_id": language.op1_language_id,
    "op2_chat_format": chat.op2_chat_format,
    "op3_sharding": sharding.op3_sharding,
    "op4_substring_dedup": substring.op4_substring_dedup,
    "op5_mixing": mixing.op5_mixing,
    "op6_ngram_jaccard_join": jaccard.op6_ngram_jaccard_join,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_benchmark_decontamination": decontaminate.op8_benchmark_decontamination,
    "op9_quality_classifier": cotrain.op9_quality_classifier,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op11_byte_bpe": bpe.op11_byte_bpe,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_periodic_runs": periods.op13_periodic_runs,
}
SQL = {
    "op2_chat_format": chat.OP2_SQL,
    "op4_substring_dedup": substring.OP4_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op6_ngram_jaccard_join": jaccard.OP6_SQL,
}
