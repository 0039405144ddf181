"""Queries over the operators of this subpackage."""
from __future__ import annotations

from almanac.llm import filter_potential, language_kernel, line_frequency, multiprobe, packing, pii_spans, prefix_bpe, pseudo_likelihood, quality_rules, shingle_forest, spelling_variants, toxicity, uniform_shards

QUERIES = {
    "op1_packing": packing.query,
    "op2_pseudo_likelihood": pseudo_likelihood.query,
    "op3_line_frequency": line_frequency.query,
    "op4_semi_markov_pii": pii_spans.query,
    "op5_multiprobe_hashing": multiprobe.query,
    "op6_rule_ensemble": quality_rules.query,
    "op7_language_kernel": language_kernel.query,
    "op8_prefix_bpe": prefix_bpe.query,
    "op9_shingle_forest": shingle_forest.query,
    "op10_kneser_ney_toxicity": toxicity.query,
    "op11_spelling_variants": spelling_variants.query,
    "op12_uniform_shards": uniform_shards.query,
    "op13_filter_potential": filter_potential.query,
}
ORACLES: dict[str, str] = {"op3_line_frequency": line_frequency.ORACLE, "op13_filter_potential": filter_potential.ORACLE}
