"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from . import exact_dedup, jaccard_join, licenses, mixing, packing, pii, quality, suffix_dedup, toxicity, vptree

QUERIES = {
    "op1_ngram_jaccard_join": jaccard_join.op1,
    "op2_quality_rules": quality.op2,
    "op3_toxicity_grammar": toxicity.op3,
    "op4_nnls_packing": packing.op4,
    "op5_source_mixing": mixing.op5,
    "op6_anchor_pii": pii.op6,
    "op7_vantage_point_trees": vptree.op7,
    "op8_exact_dedup": exact_dedup.op8,
    "op9_suffix_array_dedup": suffix_dedup.op9,
    "op10_licence_sentences": licenses.op10,
}

ORACLE_SQL = {
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op10_licence_sentences": licenses.ORACLE,
}
