"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, chat, decontaminate, merkle, metric_join, near_dup, packing, quality_pu, toxicity, two_pass_shuffle


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_merkle_audit": merkle.query,
        "op2_two_pass_shuffle": two_pass_shuffle.query,
        "op3_decontaminate": decontaminate.query,
        "op4_best_fit_packing": packing.query,
        "op5_toxicity_bigru": toxicity.query,
        "op6_byte_bpe": byte_bpe.query,
        "op7_metric_range_join": metric_join.query,
        "op8_quality_pu": quality_pu.query,
        "op9_weighted_minhash": near_dup.query,
        "op10_chat_format": chat.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_merkle_audit": merkle.SQL,
        "op3_decontaminate": decontaminate.SQL,
        "op7_metric_range_join": metric_join.SQL,
        "op10_chat_format": chat.SQL,
    }
