"""Queries and SQL of the training-data operators, for the repository's entry module."""

from __future__ import annotations

from tidemark.llm import byte_cnn, decontaminate, hard_negatives, jaccard_join, licenses, lloyd, packing, pii, quality_rules, secrets, sharding, tokens, toxicity

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_licenses": licenses.op2_licenses,
    "op3_pii": pii.op3_pii,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_packing": packing.op5_packing,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_records": tokens.op7_records,
    "op8_byte_cnn": byte_cnn.op8_byte_cnn,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_secrets": secrets.op10_secrets,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_lloyd": lloyd.op12_lloyd,
    "op13_sharding": sharding.op13_sharding,
}
SQL = {
    "op2_licenses": licenses.OP2_SQL,
    "op6_jaccard_join": jaccard_join.OP6_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op12_lloyd": lloyd.OP12_SQL,
    "op13_sharding": sharding.OP13_SQL,
}
