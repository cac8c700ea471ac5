"""Queries and SQL of this subpackage."""

from . import chat_format, collocations, decontaminate, divergence, jaccard_join, license_scan, line_dedup, mixing, ngram_lm, quality_classifier, quality_rules, token_files, toxicity

QUERIES = {
    "op1_ngram_lm": ngram_lm.op1_ngram_lm,
    "op2_quality": quality_classifier.op2_quality,
    "op3_mix": mixing.op3_mix,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op4_line_dedup_whole": line_dedup.op4_line_dedup_whole,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_token_files": token_files.op6_token_files,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_collocations": collocations.op11_collocations,
    "op12_license_scan": license_scan.op12_license_scan,
    "op13_divergence": divergence.op13_divergence,
}
SQL = {
    "op3_mix": mixing.SQL,
    "op4_line_dedup": line_dedup.SQL,
    "op5_chat_format": chat_format.SQL,
    "op8_jaccard_join": jaccard_join.SQL,
    "op10_decontaminate": decontaminate.SQL,
    "op11_collocations": collocations.SQL,
    "op12_license_scan": license_scan.SQL,
    "op13_divergence": divergence.SQL,
}
