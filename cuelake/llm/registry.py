"""Queries and SQL of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, embedding_dedup, html_extract, line_dedup, merkle, mixing, quality_rules, simhash_dedup, suffix_dedup, toxicity, warc, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": warc.op1_warc,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_simhash_dedup": simhash_dedup.op3_simhash_dedup,
        "op4_html_extract": html_extract.op4_html_extract,
        "op5_decontaminate": decontam.op5_decontaminate,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_mix_sources": mixing.op7_mix_sources,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_chat_format": chat.op10_chat_format,
        "op11_embedding_dedup": embedding_dedup.op11_embedding_dedup,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_embedding_whitening": whitening.op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.ORACLE_SQL,
        "op2_suffix_dedup": suffix_dedup.ORACLE_SQL,
        "op5_decontaminate": decontam.ORACLE_SQL,
        "op6_line_dedup": line_dedup.ORACLE_SQL,
        "op7_mix_sources": mixing.ORACLE_SQL,
        "op10_chat_format": chat.ORACLE_SQL,
        "op11_embedding_dedup": embedding_dedup.ORACLE_SQL,
        "op12_merkle_manifest": merkle.ORACLE_SQL,
    }
