"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; ``run``
writes every stage's result as Parquet to the shared folder and reads it back; what a stage wrote
on its way, and the result before it, are deleted then. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm import language, mixing, neardup, packing
from grainmill.llm.common import cleared, materialize, remove, shared_dir

#: A document goes whose predicted language has a lower score: neither family nor language is told with an even chance.
LEAST_SCORE = 0.4


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents go whose language cannot be told (``und``, or a score below LEAST_SCORE); a null lang becomes the predicted one."""
    return language.recognised(docs, language.fit(docs, sample=2000), least=LEAST_SCORE)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of near duplicates the one with the smallest id stays, of rows that repeat its id the first by all columns; rows without an id stay."""
    ids = neardup.near_duplicates(docs, percent=75).where("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    ids = materialize(ids)
    # the ids kept grow with the corpus, so they are never broadcast: one shuffle of the texts at every size
    kept = docs.join(ids.where("rows = 1").select("doc_id").hint("merge"), "doc_id", "left_semi").select(*docs.columns)
    if not ids.where("rows > 1").isEmpty():
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        again = docs.join(ids.where("rows > 1").select("doc_id").hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("row"))
        kept = kept.unionByName(again.select(*(F.col("row").getField(c).alias(c) for c in docs.columns)))
    return kept.unionByName(docs.where("doc_id is null"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: sources come near their target weights; a document may come up to three times, or not at all."""
    return mixing.mixed(docs, most=3.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: sequences of at most 4096 tokens, with their ids."""
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096, with_ids=True)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: SQL cannot express the stages' models and tokenizers; tests/llm compares them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = shared_dir(spark)
        with cleared(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
