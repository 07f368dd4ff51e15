"""Queries of this subpackage and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from thresher.llm import bpe, bytebpe, chat, jaccard, langid, media, packing, quality, sharding, spelling, topk, toxicity, veccodes


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media": media.op1_media,
        "op2_jaccard": jaccard.op2_jaccard,
        "op3_quality": quality.op3_quality,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_chat": chat.op5_chat,
        "op6_language_id": langid.op6_language_id,
        "op7_packing": packing.op7_packing,
        "op8_sharding": sharding.op8_sharding,
        "op9_bpe": bpe.op9_bpe,
        "op10_topk": topk.op10_topk,
        "op11_spelling": spelling.op11_spelling,
        "op12_byte_bpe": bytebpe.op12_byte_bpe,
        "op13_vector_codes": veccodes.op13_vector_codes,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_jaccard": jaccard.OP2_SQL,
        "op5_chat": chat.OP5_SQL,
        "op10_topk": topk.OP10_SQL,
        "op11_spelling": spelling.OP11_SQL,
        "op13_vector_codes": veccodes.OP13_SQL,
    }
