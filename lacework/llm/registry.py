"""Queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from . import decontaminate, importance, jaccard_join, licenses, line_dedup, link_trust, mixing, nn_descent, quality, suffix_index, suffix_tree, token_alignment, toxicity

QUERIES = {
    "op1_suffix_tree_scores": suffix_tree.op1_suffix_tree_scores,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_source_mixing": mixing.op8_source_mixing,
    "op9_embedding_near_dedup": nn_descent.op9_embedding_near_dedup,
    "op10_suffix_index_dedup": suffix_index.op10_suffix_index_dedup,
    "op11_token_alignment": token_alignment.op11_token_alignment,
    "op12_url_filters": link_trust.op12_url_filters,
    "op13_importance_resampling": importance.op13_importance_resampling,
}
SQL = {
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op5_benchmark_decontamination": decontaminate.OP5_SQL,
    "op6_jaccard_join": jaccard_join.OP6_SQL,
    "op8_source_mixing": mixing.OP8_SQL,
    "op12_url_filters": link_trust.OP12_SQL,
}
