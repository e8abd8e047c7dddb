"""The queries of this subpackage, with production parameters over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.llm import jaccard_join, langid, lattice, packing, pii, piece_rounds, progressive_jpeg, secret_scan, token_counts, token_store
from weft.llm.common import table


def _on(operator: Callable[[DataFrame], DataFrame], name: str = "documents") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_surrogates": _on(pii.surrogates),
        "op2_token_counts": _on(token_counts.token_counts),
        "op3_language_id": _on(langid.language_id),
        "op4_lattice_near_pairs": _on(lattice.near_links, "embeddings"),
        "op5_token_store": _on(token_store.token_store),
        "op6_secret_scan": _on(secret_scan.secret_scan),
        "op7_piece_rounds": _on(piece_rounds.encode),
        "op8_best_fit_packing": _on(packing.best_fit_packing),
        "op9_jaccard_pairs": _on(jaccard_join.jaccard_links),
        "op10_page_tensors": _on(progressive_jpeg.page_tensors, "pages"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_jaccard_pairs": jaccard_join.ORACLE}
