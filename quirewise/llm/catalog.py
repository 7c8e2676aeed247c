"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import collocations, exact_dedup, language_id, line_dedup, mixing, ngram_join, packing, pii, pseudo_likelihood, quality, quality_rules, quotation, vector_codes

QUERIES = {
    "op5_lm_scores": pseudo_likelihood.op5_lm_scores,
    "op6_chat_quotes": quotation.op6_chat_quotes,
    "op1_pii": pii.op1_pii,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op2_quality": quality.op2_quality,
    "op10_ngram_join": ngram_join.op10_ngram_join,
    "op9_packing": packing.op9_packing,
    "op8_mixing": mixing.op8_mixing,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op11_language_id": language_id.op11_language_id,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE_SQL = {
    "op8_mixing": mixing.SQL,
    "op4_line_dedup": line_dedup.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
    "op10_ngram_join": ngram_join.SQL,
    "op12_vector_codes": vector_codes.SQL,
    "op13_collocations": collocations.SQL,
}
