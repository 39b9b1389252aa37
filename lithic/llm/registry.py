"""Queries of this package for the driver."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import linededup, media, mixing, packing, quality, sharding, simhash, tokencounts, tokenids, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": linededup.op1_line_dedup,
        "op2_packing": packing.op2_packing,
        "op3_mixing": mixing.op3_mixing,
        "op4_simhash": simhash.op4_simhash,
        "op5_token_ids": tokenids.op5_token_ids,
        "op6_quality": quality.op6_quality,
        "op7_sharding": sharding.op7_sharding,
        "op8_topk": topk.op8_topk,
        "op9_media": media.op9_media,
        "op10_token_counts": tokencounts.op10_token_counts,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mixing": mixing.OP3_SQL,
        "op7_sharding": sharding.OP7_SQL,
        "op8_topk": topk.OP8_SQL,
    }
