"""Queries of the llm operators with production parameters, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from grainmill.llm import importance, language, line_dedup, mixing, neardup, oracles, packing, prefix_trie, sharding, token_counts, token_store, vectors, warc
from grainmill.llm.common import read


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), percent=75)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_store(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"), least=0.9)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(read(spark, sf_dir, "documents"), sample=2000)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(read(spark, sf_dir, "pages"), segment_bytes=32768, revisit_from=100)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards_by_bytes(read(spark, sf_dir, "documents"), shards=40)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(read(spark, sf_dir, "documents")).drop("n_copies")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(read(spark, sf_dir, "embeddings"), k=20, every=20)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(read(spark, sf_dir, "documents"), least_chars=40, least_docs=5)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"), family_size=20)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), percent=10, least_words=20, most=1, buckets=10_000, seed="2024")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {f.__name__: f for f in (op1_near_duplicates, op2_token_store, op3_packing, op4_near_vectors, op5_language, op6_warc, op7_sharding, op8_token_counts, op9_mixing, op10_nearest, op11_line_dedup, op12_prefix_trie, op13_importance, pipeline)}


def oracle_sql():
    """op2, op3, op5, op7, op8 and the pipeline have none: SQL has no tokenizer, model or label propagation."""
    return {
        "op1_near_duplicates": oracles.NEAR_DUPLICATES, "op4_near_vectors": oracles.NEAR_VECTORS, "op6_warc": oracles.WARC,
        "op9_mixing": oracles.MIXING, "op10_nearest": oracles.NEAREST, "op11_line_dedup": oracles.LINES, "op12_prefix_trie": oracles.TRIE, "op13_importance": oracles.IMPORTANCE,
    }
