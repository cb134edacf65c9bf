"""Queries and oracle SQL of the text operators."""

from __future__ import annotations

from . import chat_format, decontaminate, embedding_dedup, exact_dedup, fill_middle, hard_negatives, mixing, ngram_join, pii, quality, secret_scan, suffix_dedup, url_filter

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_quality": quality.op4_quality,
    "op5_chat_perspectives": chat_format.op5_chat_perspectives,
    "op6_pii_surrogates": pii.op6_pii_surrogates,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_embedding_dedup": embedding_dedup.op11_embedding_dedup,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}

ORACLES = {
    "op11_embedding_dedup": embedding_dedup.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_fill_middle": fill_middle.OP13_SQL,
    "op5_chat_perspectives": chat_format.OP5_SQL,
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op1_ngram_jaccard_join": ngram_join.OP1_SQL,
    "op2_exact_dedup": exact_dedup.OP2_SQL,
}
