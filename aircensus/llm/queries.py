"""Registry of the queries of this subpackage and their SQL."""

from __future__ import annotations

from . import collocations, decontaminate, dedup_bytes, dedup_words, hard_negatives, jaccard_join, mixing, pii_scan, quality_rank, quality_rules, secret_scan, simhash, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op3_suffix_dedup": dedup_bytes.op3_suffix_dedup,
    "op8_substring_dedup": dedup_words.op8_substring_dedup,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op7_quality_rank": quality_rank.op7_quality_rank,
    "op4_toxicity": toxicity.op4_toxicity,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op6_mixing": mixing.op6_mixing,
    "op10_pii_scan": pii_scan.op10_pii_scan,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op11_simhash": simhash.op11_simhash,
    "op12_collocations": collocations.op12_collocations,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
ORACLE_SQL: dict[str, str] = {
    "op9_jaccard_join": jaccard_join.ORACLE,
    "op3_suffix_dedup": dedup_bytes.ORACLE,
    "op8_substring_dedup": dedup_words.ORACLE,
    "op1_decontaminate": decontaminate.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
