"""Operators of a training-data pipeline, with their queries and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, html_extract, language_id, mixing, ngram_join, packing, quality, sharding, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_topk": topk.op1_exact_topk,
        "op2_language_id": language_id.op2_language_id,
        "op3_sharding": sharding.op3_sharding,
        "op4_packing": packing.op4_packing,
        "op5_chat_formatting": chat.op5_chat_formatting,
        "op6_mixing": mixing.op6_mixing,
        "op7_ngram_join": ngram_join.op7_ngram_join,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_html_extraction": html_extract.op10_html_extraction,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_topk": topk.ORACLE, "op5_chat_formatting": chat.ORACLE, "op6_mixing": mixing.ORACLE.format(docs="documents")}
