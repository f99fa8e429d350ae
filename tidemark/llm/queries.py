"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_QUERIES = {
    "op1_quality_scores": "quality",
    "op2_token_files": "token_files",
    "op3_near_duplicates": "near",
    "op4_languages": "language",
    "op5_token_counts": "token_counts",
    "op6_ball_tree_top_k": "topk",
    "op7_contaminated": "decontaminate",
    "op8_main_text": "html",
    "op9_mix_sources": "mixing",
    "op10_chat_windows": "chat",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from . import mixing, topk

    return {"op6_ball_tree_top_k": topk.ORACLE_SQL, "op9_mix_sources": mixing.ORACLE_SQL}
