"""The corpus as entities: heads, versions, provenance, repositories and licences, each a table of its own, over the driver's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions.text import APPROVED_LICENSES, stable_id
from grainmill.sources import corpus

#: Licences that repositories of the corpus declare: the approved ones, and two that are not.
LICENSES = [*APPROVED_LICENSES, "GPL-3.0", "CC-BY-NC-4.0"]


def _digit(column: str):
    """A number from 0 to 15 that a value's hash decides."""
    return F.conv(F.substring(F.sha2(column, 256), 1, 1), 16, 10).cast("int")


def licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"lic-{x.lower()}", x, x in APPROVED_LICENSES) for x in LICENSES], "license_id string, spdx_id string, allowed boolean")


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a source of the documents."""
    d = corpus.read(spark, sf_dir, "documents").where("source is not null").select("source").distinct()
    return d.select(
        stable_id("src", F.col("source")).alias("source_repository_id"), F.concat(F.lit("owner/"), "source").alias("repository"), F.when(_digit("source") < 12, "github").otherwise("bundled").alias("provider"),
        F.concat(F.lit("https://host.example/"), "source").alias("repository_source_url"), (_digit("source") % 2 == 0).alias("trusted"),
    )


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a query came from. Texts of some lengths lack an author or a licence."""
    d = corpus.read(spark, sf_dir, "documents").where("source is not null")
    size, commit = F.length("text"), F.substring(F.sha2("text", 256), 1, 40)
    return d.select(
        F.col("doc_id").cast("string").alias("query_id"), stable_id("src", F.col("source")).alias("source_repository_id"),
        F.when(size % 7 != 0, F.concat(F.lit("lic-"), F.lower(F.element_at(F.array(*map(F.lit, LICENSES)), _digit("source") % len(LICENSES) + 1)))).alias("license_id"),
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source_path"), commit.alias("commit_sha"),
        F.when(size % 9 == 0, "").otherwise(F.concat(F.lit("author-"), "source")).alias("original_author"),
        F.concat(F.lit("https://host.example/"), "source", F.lit("/blob/"), commit).alias("provenance_source_url"), F.when(F.col("lang") == "de", F.concat(F.lit("Notice of "), "source")).alias("required_notice"),
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first version of every document, and a second one, with another title, where the text was edited."""
    d = corpus.spread(corpus.read(spark, sf_dir, "documents"))
    size, first = F.length("text"), F.substring_index("text", "\n", 1)
    number = F.explode(F.when(_edited(), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    dialect = F.coalesce(*(F.when(F.col("lang") == k, F.lit(v)) for k, v in corpus.DIALECTS.items()))
    title = F.trim(F.substring(first, 1, 180))
    rows = d.select("doc_id", "text", "lang", number.alias("version_number"), size.alias("size"), title.alias("_title"), dialect.alias("dialect"))
    return rows.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("-v"), F.col("version_number").cast("string")).alias("version_id"), F.col("doc_id").cast("string").alias("query_id"), "version_number",
        F.when(F.col("version_number") == 2, F.concat(F.lit("Edited: "), "_title")).otherwise(F.col("_title")).alias("title"), F.col("text").alias("kql"),
        F.substr("text", F.length(F.substring_index("text", "\n", 1)) + 2).alias("description"), F.substring_index("text", "\n", -1).alias("explanation"), "dialect",
        F.to_json(F.array_sort(F.array_distinct(F.regexp_extract_all("_title", F.lit("[a-z]{6,}"), F.lit(0))))).alias("tables_json"),
        F.when(F.col("size") % 11 == 0, "not a list").otherwise(F.concat(F.lit('["'), F.coalesce("lang", F.lit("none")), F.lit('", 3]'))).alias("assumptions_json"),
        (F.col("size") % 6 == 0).alias("ai_generated"), F.when(F.col("size") % 6 == 0, "local").alias("generation_model"), F.sha2("text", 256).alias("content_hash"), (F.col("doc_id") % 150).alias("created_by_user_id"),
    )


def _edited():
    return F.coalesce(F.length("text") % 4 == 0, F.lit(False))


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a query: who owns it, who may read it, its current version, stars and times."""
    d = corpus.read(spark, sf_dir, "documents").withColumn("kql", F.col("text"))
    d = d.select("doc_id", "kql", _edited().alias("edited"), (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("created_at"))
    rows = corpus.labelled(d, spark, sf_dir).drop("kql")
    stars = corpus.stars(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("star_count"))
    rows = rows.join(stars, "doc_id", "left").withColumn("star_count", F.coalesce("star_count", F.lit(0).cast("long")))
    return rows.select(
        "doc_id", F.col("doc_id").cast("string").alias("query_id"), (F.col("doc_id") % 150).alias("owner_id"), "visibility", "moderation_status", "deleted", "star_count",
        F.concat(F.col("doc_id").cast("string"), F.when(F.col("edited"), "-v2").otherwise("-v1")).alias("current_version_id"), "created_at",
        F.when(F.col("edited"), F.col("created_at") + F.expr("interval 1 day")).otherwise(F.col("created_at")).alias("updated_at"), F.when(F.col("visibility") == "public", F.col("created_at")).alias("published_at"),
    )
