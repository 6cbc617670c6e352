"""Queries of the training-data operators, one opN_<name> each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import binary_output, exact_dedup, jaccard_join, language_id, license_scan, mixing, packing, quality_rules, separator_scan, suffix_dedup
from .shared import documents


def _on_documents(query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": _on_documents(packing.packing_query),
        "op2_exact_dedup": _on_documents(exact_dedup.exact_dedup_query),
        "op3_quality_rules": _on_documents(quality_rules.quality_rules_query),
        "op4_suffix_dedup": _on_documents(suffix_dedup.suffix_dedup_query),
        "op5_binary_output": _on_documents(binary_output.binary_output_query),
        "op6_license_scan": _on_documents(license_scan.license_scan_query),
        "op7_mixing": _on_documents(mixing.mixing_query),
        "op8_language_id": _on_documents(language_id.language_id_query),
        "op9_token_counts": _on_documents(separator_scan.token_counts_query),
        "op10_jaccard_join": _on_documents(jaccard_join.jaccard_join_query),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": exact_dedup.EXACT_DEDUP_SQL,
        "op3_quality_rules": quality_rules.QUALITY_RULES_SQL,
        "op6_license_scan": license_scan.LICENSE_SCAN_SQL,
        "op7_mixing": mixing.MIXING_SQL,
        "op10_jaccard_join": jaccard_join.JACCARD_JOIN_SQL,
    }
