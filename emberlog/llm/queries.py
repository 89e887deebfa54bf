"""The registered queries of this folder and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberlog.llm import (
    bitmap_manifest,
    edit_leaks,
    feast_whitening,
    hamming_minhash,
    license_rules,
    list_asof,
    merkle_audit,
    poly_dedup,
    rank_order,
    residual_packing,
    semi_crf,
    site_template,
    vertical_jaccard,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_site_template_text": site_template.op1_site_template_text,
    "op2_semi_markov_pii": semi_crf.op2_semi_markov_pii,
    "op3_list_asof_filter": list_asof.op3_list_asof_filter,
    "op4_pigeonhole_decontamination": edit_leaks.op4_pigeonhole_decontamination,
    "op5_license_rules": license_rules.op5_license_rules,
    "op6_exact_dedup": poly_dedup.op6_exact_dedup,
    "op7_minhash_near_dedup": hamming_minhash.op7_minhash_near_dedup,
    "op8_best_fit_packing": residual_packing.op8_best_fit_packing,
    "op9_merkle_fixity": merkle_audit.op9_merkle_fixity,
    "op10_rank_order_language": rank_order.op10_rank_order_language,
    "op11_feast_whitening": feast_whitening.op11_feast_whitening,
    "op12_bitmap_rank_manifest": bitmap_manifest.op12_bitmap_rank_manifest,
    "op13_vertical_jaccard": vertical_jaccard.op13_vertical_jaccard,
}
ORACLE: dict[str, str] = {
    "op3_list_asof_filter": list_asof.OP3_SQL,
    "op5_license_rules": license_rules.OP5_SQL,
    "op6_exact_dedup": poly_dedup.OP6_SQL,
    "op9_merkle_fixity": merkle_audit.OP9_SQL,
    "op12_bitmap_rank_manifest": bitmap_manifest.OP12_SQL,
    "op13_vertical_jaccard": vertical_jaccard.OP13_SQL,
}
