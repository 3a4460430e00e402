"""The corpus operators' queries, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tripleframe.llm import chat, decontam, lattice, lines, mixing, quality, secretscan, simhash, substrings, tokencount


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    t = _table
    return {
        "op1_mix_sources": lambda s, d: mixing.mix_sources(t(s, d, "documents"), mixing.TARGETS, mixing.OTHERS),
        "op2_substring_dedup": lambda s, d: substrings.repeated_substrings(t(s, d, "documents")),
        "op3_lm_scores": lambda s, d: lattice.lm_scores(t(s, d, "documents")),
        "op4_line_dedup": lambda s, d: lines.drop_repeated_lines(t(s, d, "documents")),
        "op5_quality_rules": lambda s, d: quality.quality_scores(t(s, d, "documents"), t(s, d, "labels")),
        "op6_decontaminate": lambda s, d: decontam.contaminated(t(s, d, "documents"), t(s, d, "benchmark")),
        "op7_token_counts": lambda s, d: tokencount.token_counts(t(s, d, "documents")),
        "op8_chat_format": lambda s, d: chat.format_chats(t(s, d, "conversations")),
        "op9_secret_scan": lambda s, d: secretscan.find_secrets(t(s, d, "documents")),
        "op10_near_dedup": lambda s, d: simhash.near_duplicates(t(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": substrings.SQL, "op4_line_dedup": lines.SQL, "op8_chat_format": chat.SQL}
