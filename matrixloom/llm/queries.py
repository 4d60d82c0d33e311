"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import bpe, divergence, jaccard_join, line_dedup, packing, quality, simhash, spelling, substring_dedup, token_counts, topk, toxicity, url_filters

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_url_filters": url_filters.op2_url_filters,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op8_exact_topk": topk.op8_exact_topk,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_byte_bpe": bpe.op10_byte_bpe,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_jaccard_join": jaccard_join.op13_jaccard_join,
}

ORACLES = {
    "op1_quality_rules": quality.OP1_SQL,
    "op2_url_filters": url_filters.OP2_SQL,
    "op5_substring_dedup": substring_dedup.OP5_SQL,
    "op8_exact_topk": topk.OP8_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
    "op13_jaccard_join": jaccard_join.OP13_SQL,
}
