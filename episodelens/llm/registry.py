"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from . import language_id, ngram_join, piece_lattice, quality_rank, quality_rules, source_mixing, substring_dedup, topk_search, toxicity_mil, warc_archive

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_quality_classifier": quality_rank.op2_quality_classifier,
    "op3_exact_topk": topk_search.op3_exact_topk,
    "op4_toxicity": toxicity_mil.op4_toxicity,
    "op5_source_mixing": source_mixing.op5_source_mixing,
    "op6_warc": warc_archive.op6_warc,
    "op7_language_id": language_id.op7_language_id,
    "op8_sentencepiece": piece_lattice.op8_sentencepiece,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}
ORACLES = {
    "op1_ngram_jaccard_join": ngram_join.ORACLE,
    "op3_exact_topk": topk_search.ORACLE,
    "op6_warc": warc_archive.ORACLE,
    "op10_substring_dedup": substring_dedup.ORACLE,
}
