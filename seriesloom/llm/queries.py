"""Registry of the numbered operators' queries and of their SQL, where SQL can express them."""

from __future__ import annotations

from . import collocations, exact_dedup, importance, language_id, license_scan, line_rules, mixing, ngram_join, packing, repeated_spans, sharding, transport_media, tree_weighting

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_transport_media": transport_media.op2_transport_media,
    "op3_sentence_rules": license_scan.op3_sentence_rules,
    "op4_residual_packing": packing.op4_residual_packing,
    "op5_pareto_mix": mixing.op5_pareto_mix,
    "op6_bounded_ring": sharding.op6_bounded_ring,
    "op7_language_id": language_id.op7_language_id,
    "op8_repeated_spans": repeated_spans.op8_repeated_spans,
    "op9_tree_weighting": tree_weighting.op9_tree_weighting,
    "op10_block_naming": exact_dedup.op10_block_naming,
    "op11_phrase_collocations": collocations.op11_phrase_collocations,
    "op12_line_rules": line_rules.op12_line_rules,
    "op13_importance_resampling": importance.op13_importance_resampling,
}
SQL = {
    "op3_sentence_rules": license_scan.SQL,
    "op10_block_naming": exact_dedup.SQL,
    "op11_phrase_collocations": collocations.SQL,
    "op12_line_rules": line_rules.SQL,
    "op13_importance_resampling": importance.SQL,
}
