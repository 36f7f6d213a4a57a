"""Queries of this package by name, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.llm import embeddings, langid, linededup, mixing, packing, pii, quality, simhash, suffixes, token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality.query,
        "op2_pii": pii.query,
        "op3_language_id": langid.query,
        "op4_packing": packing.query,
        "op5_embedding_dedup": embeddings.query,
        "op6_suffix_dedup": suffixes.query,
        "op7_token_counts": token_counts.query,
        "op8_mixing": mixing.query,
        "op9_line_dedup": linededup.query,
        "op10_simhash": simhash.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_suffix_dedup": suffixes.ORACLE,
        "op9_line_dedup": linededup.ORACLE,
    }
