"""Queries of this subpackage and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeseek.llm import decontaminate, license_scan, ngram_join, packing, pii, quality, suffix_dedup, token_counts, topk, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_license_scan": license_scan.query,
        "op2_decontaminate": decontaminate.query,
        "op3_best_fit_packing": packing.query,
        "op4_pii": pii.query,
        "op5_exact_topk": topk.query,
        "op6_token_counts": token_counts.query,
        "op7_ngram_join": ngram_join.query,
        "op8_url_filter": url_filter.query,
        "op9_suffix_dedup": suffix_dedup.query,
        "op10_quality_classifier": quality.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.oracle(), "op2_decontaminate": decontaminate.oracle(), "op5_exact_topk": topk.oracle(), "op7_ngram_join": ngram_join.oracle(), "op9_suffix_dedup": suffix_dedup.oracle()}
