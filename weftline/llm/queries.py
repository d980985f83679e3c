"""Queries of this subpackage: each operator over its whole table with production parameters."""

from __future__ import annotations

from weftline.llm import automaton_dedup, bitplane, drr_packing, html_mss, knapsack_mix, lsm_dedup, secrets_dp, simhash_trie, tiff, weak_quality
from weftline.session import table

QUERIES = {
    "op1_bitplane_ids": lambda spark, sf_dir: bitplane.op1(table(spark, sf_dir, "documents")),
    "op2_tiff_media": lambda spark, sf_dir: tiff.op2(table(spark, sf_dir, "documents")),
    "op3_drr_packing": lambda spark, sf_dir: drr_packing.op3(table(spark, sf_dir, "documents")),
    "op4_html_mss": lambda spark, sf_dir: html_mss.op4(table(spark, sf_dir, "pages")),
    "op5_lsm_dedup": lambda spark, sf_dir: lsm_dedup.op5(table(spark, sf_dir, "documents")),
    "op6_secret_scan": lambda spark, sf_dir: secrets_dp.op6(table(spark, sf_dir, "documents")),
    "op7_knapsack_mix": lambda spark, sf_dir: knapsack_mix.op7(table(spark, sf_dir, "documents")),
    "op8_automaton_dedup": lambda spark, sf_dir: automaton_dedup.op8(table(spark, sf_dir, "documents")),
    "op9_weak_quality": lambda spark, sf_dir: weak_quality.op9(table(spark, sf_dir, "documents")),
    "op10_simhash_trie": lambda spark, sf_dir: simhash_trie.op10(table(spark, sf_dir, "documents")),
}

ORACLES = {"op5_lsm_dedup": lsm_dedup.OP5_SQL, "op8_automaton_dedup": automaton_dedup.OP8_SQL}
