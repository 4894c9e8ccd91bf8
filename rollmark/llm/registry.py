"""Queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from . import exact_dedup, language_id, line_templates, near_dedup, packing, pieces, quality_classifier, quality_rules, substring_dedup, toxicity

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_line_templates": line_templates.op2_line_templates,
    "op3_packing": packing.op3_packing,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_language_id": language_id.op7_language_id,
    "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}

ORACLES = {
    "op2_line_templates": line_templates.ORACLE,
    "op4_quality_rules": quality_rules.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op10_substring_dedup": substring_dedup.ORACLE,
}
