"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import decontamination, jaccard_join, language_id, quality_model, quality_rules, sentencepiece_lattice, suffix_dedup, token_counts, toxicity, url_filters



def pipeline(spark, sf_dir: str):
    """The stages of corpus_pipeline.py, imported when they run: the operators stand without it."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_quality_classifier": quality_model.op2_quality_classifier,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_url_filters": url_filters.op6_url_filters,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_language_id": language_id.op8_language_id,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_sentencepiece": sentencepiece_lattice.op10_sentencepiece,
    "pipeline": pipeline,
}
ORACLES = {
    "op4_quality_rules": quality_rules.SQL,
}
