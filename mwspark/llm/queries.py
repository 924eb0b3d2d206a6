"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mwspark.llm import bpe, conversation_trie, embed_dedup, hard_negatives, html_text, jaccard, langid, licenses, packing, secrets, sharding, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_ownership": secrets.op1_secret_ownership,
        "op2_bounded_packing": packing.op2_bounded_packing,
        "op3_naive_bayes_language": langid.op3_naive_bayes_language,
        "op4_license_inheritance": licenses.op4_license_inheritance,
        "op5_byte_bpe": bpe.op5_byte_bpe,
        "op6_metric_jaccard_join": jaccard.op6_metric_jaccard_join,
        "op7_vector_sharding": sharding.op7_vector_sharding,
        "op8_kneser_ney_toxicity": toxicity.op8_kneser_ney_toxicity,
        "op9_cross_polytope_dedup": embed_dedup.op9_cross_polytope_dedup,
        "op10_top_k_search": topk.op10_top_k_search,
        "op11_composite_text_density": html_text.op11_composite_text_density,
        "op12_cover_tree_negatives": hard_negatives.op12_cover_tree_negatives,
        "op13_conversation_trie": conversation_trie.op13_conversation_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_top_k_search": topk.ORACLE, "op12_cover_tree_negatives": hard_negatives.ORACLE, "op13_conversation_trie": conversation_trie.ORACLE}
