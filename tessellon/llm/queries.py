"""The training-data queries over the driver tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tessellon.llm import bpe, chat_format, contamination, jaccard_join, metric_search, pii, quality, secret_scan, suffix_dedup, token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": pii.op1_pii,
        "op2_metric_topk": metric_search.op2_metric_topk,
        "op3_chat_format": chat_format.op3_chat_format,
        "op4_bpe": bpe.op4_bpe,
        "op5_decontaminate": contamination.op5_decontaminate,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_jaccard_join": jaccard_join.op8_jaccard_join,
        "op9_quality": quality.op9_quality,
        "op10_secret_scan": secret_scan.op10_secret_scan,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_metric_topk": metric_search.SQL, "op3_chat_format": chat_format.SQL}
