"""The registered queries of the operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, cover, graph, hadamard, minhash, mixing, packing, pii, quality, repair, simhash, suffix, toxicity
from .tables import table


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_pairs(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                       public_tokenizers.PATTERN)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"))


def op4_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_bytes_removed(table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nearest(table(spark, sf_dir, "embeddings"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover.repeated_windows_removed(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.allotted(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hadamard.clustered(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(table(spark, sf_dir, "conversations"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_personal_data": op3_personal_data,
    "op4_simhash_near_duplicates": op4_simhash_near_duplicates,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_mixing": op8_mixing,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_packing": op13_packing,
}

SQL: dict[str, str] = {"op7_substring_dedup": cover.SQL, "op8_mixing": mixing.SQL, "op11_centroid_clusters": hadamard.SQL}
