"""Queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, language_id, mixing, near_dedup, repetition, secrets, toxicity, training_order, url_filter
from .common import ship


def _sent(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return query


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root not in sys.path:
        sys.path.append(root)
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: _sent(f)
    for f in (
        secrets.op1_secret_scan, url_filter.op2_url_filter, mixing.op3_temperature_mix, chat_format.op4_perspectives, near_dedup.op5_minhash_forest,
        repetition.op6_suffix_repetition, decontaminate.op7_decontaminate, language_id.op8_language_crf, toxicity.op9_toxicity_channel,
        training_order.op10_training_order, pipeline,
    )
}

#: op1, op8, op9, op10 and the pipeline hold a shortest path, learned models or a cipher, which SQL doesn't express.
ORACLES = {
    "op2_url_filter": url_filter.SQL_OP2, "op3_temperature_mix": mixing.SQL_OP3, "op4_perspectives": chat_format.SQL_OP4, "op5_minhash_forest": near_dedup.SQL_OP5,
    "op6_suffix_repetition": repetition.SQL_OP6, "op7_decontaminate": decontaminate.SQL_OP7,
}
