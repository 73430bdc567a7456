"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embeddings, jaccard_join, licenses, media, mixing, packing, quality, sharding, tokens, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_near_dedup": embeddings.op1_embedding_near_dedup,
        "op2_token_counts": tokens.op2_token_counts,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_extendible_sharding": sharding.op4_extendible_sharding,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_license_scan": licenses.op6_license_scan,
        "op7_media_columns": media.op7_media_columns,
        "op8_quality_classifier": quality.op8_quality_classifier,
        "op9_ngram_jaccard_join": jaccard_join.op9_ngram_jaccard_join,
        "op10_mixing_to_targets": mixing.op10_mixing_to_targets,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_near_dedup": embeddings.SQL,
        "op4_extendible_sharding": sharding.SQL,
        "op9_ngram_jaccard_join": jaccard_join.SQL,
        "op10_mixing_to_targets": mixing.SQL,
    }
