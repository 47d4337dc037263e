"""The subpackage's queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from mnemospark.llm import op1_packing, op2_pii, op3_licenses, op4_ngram_join, op5_token_files, op6_language, op7_decontamination, op8_line_dedup, op9_exact_dedup, op10_quality, op11_hard_negatives, op12_mixing, op13_alignment

QUERIES = {
    "op1_packing": op1_packing.op1_packing,
    "op2_pii": op2_pii.op2_pii,
    "op3_licenses": op3_licenses.op3_licenses,
    "op4_ngram_join": op4_ngram_join.op4_ngram_join,
    "op5_token_files": op5_token_files.op5_token_files,
    "op6_language": op6_language.op6_language,
    "op7_decontamination": op7_decontamination.op7_decontamination,
    "op8_line_dedup": op8_line_dedup.op8_line_dedup,
    "op9_exact_dedup": op9_exact_dedup.op9_exact_dedup,
    "op10_quality": op10_quality.op10_quality,
    "op11_hard_negatives": op11_hard_negatives.op11_hard_negatives,
    "op12_mixing": op12_mixing.op12_mixing,
    "op13_alignment": op13_alignment.op13_alignment,
}
SQL = {"op9_exact_dedup": op9_exact_dedup.SQL, "op11_hard_negatives": op11_hard_negatives.SQL, "op12_mixing": op12_mixing.SQL}
