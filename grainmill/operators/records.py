"""Whole records of queries: heads with their current version, provenance, repository and licence, flat and nested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.text import strip_strings
from grainmill.operators.feeds import iso, with_star_flag
from grainmill.operators.visibility import readable

#: Parts without which a provenance says nothing: all of them, or none is shown.
PARTS = ("source_repository_id", "source_path", "commit_sha", "original_author", "provenance_source_url", "repository", "license_spdx")


def detail_rows(heads: DataFrame, versions: DataFrame, provenance: DataFrame, repositories: DataFrame, licenses: DataFrame, stars: DataFrame, viewer: int) -> DataFrame:
    """Flat rows of what the viewer may read.

    A head without its current version has no row; provenance, repository and licence may lack.
    Heads are filtered before any join. The joins on ids are left to the optimiser: repositories
    and licences are small as a rule and then broadcast by their measured size, else shuffled.
    """
    own = with_star_flag(heads.where(readable(viewer)), stars, viewer)
    own = own.withColumnsRenamed({"created_at": "query_created_at", "updated_at": "query_updated_at"})
    now = versions.drop("query_id").withColumnRenamed("version_id", "current_version_id")
    # a query repeated in the provenance would repeat its row
    came = provenance.groupBy("query_id").agg(F.min(F.struct(*(c for c in provenance.columns if c != "query_id"))).alias("p")).select("query_id", "p.*")
    rows = own.join(now, "current_version_id").join(came, "query_id", "left").join(repositories, "source_repository_id", "left")
    return rows.join(licenses.select("license_id", F.col("spdx_id").alias("license_spdx")), "license_id", "left")


def whole_provenance() -> Column:
    """A struct with all parts, or null where one of PARTS is null or empty."""
    whole = F.lit(True)
    for c in PARTS:
        whole = whole & F.coalesce(F.col(c) != "", F.lit(False))
    return F.when(whole, F.struct(
        F.col("repository").alias("source_name"), F.col("provenance_source_url").alias("source_url"), "repository", F.col("repository_source_url").alias("repository_url"), "provider", "license_spdx",
        F.coalesce("trusted", F.lit(False)).alias("trusted"), "source_repository_id", "source_path", "commit_sha", "original_author", F.coalesce("required_notice", F.lit("")).alias("required_notice"),
    ))


def nested(rows: DataFrame) -> DataFrame:
    """Records of detail rows: the head's fields, its current version and its provenance as structs; lists that are no JSON lists are empty."""
    version = F.struct(
        F.col("current_version_id").alias("id"), "query_id", "version_number", "title", "kql", "description", "explanation", "dialect", strip_strings(F.col("tables_json")).alias("tables"),
        strip_strings(F.col("assumptions_json")).alias("assumptions"), "ai_generated", "generation_model", "content_hash", "created_by_user_id",
    )
    return rows.select(
        "query_id", "owner_id", "visibility", "moderation_status", "current_version_id", "star_count", F.col("repository").alias("source_repository"), F.col("repository_source_url").alias("source_repository_url"),
        "starred_by_viewer", iso("query_created_at").alias("created_at"), iso("query_updated_at").alias("updated_at"), iso("published_at").alias("published_at"),
        version.alias("current_version"), whole_provenance().alias("provenance"),
    )


def flattened(records: DataFrame) -> DataFrame:
    """Records as an interface returns them: the version's fields beside the head's, its id as version_id."""
    fields = [f for f in records.schema["current_version"].dataType.names if f not in ("id", "query_id")]
    return records.select(*(c for c in records.columns if c != "current_version"), F.col("current_version.id").alias("version_id"), *(F.col(f"current_version.{f}") for f in fields))


def totals(heads: DataFrame, versions: DataFrame, repositories: DataFrame, provenance: DataFrame, index: DataFrame, jobs: DataFrame) -> DataFrame:
    """How many rows each part of the corpus has, one row; every part is counted by partial sums of one tagged union."""
    one = lambda rows, name, keep=None: rows.select(F.lit(name).alias("part"), (F.lit(True) if keep is None else keep).alias("kept"))
    parts = {"queries": heads, "versions": versions, "sources": repositories, "provenance": provenance, "indexed": index, "jobs": jobs}
    tagged = one(repositories, "github_sources", F.coalesce(F.col("provider") == "github", F.lit(False)))
    for name, rows in parts.items():
        tagged = tagged.unionByName(one(rows, name))
    return tagged.agg(*(F.count_if((F.col("part") == n) & F.col("kept")).alias(n) for n in [*parts, "github_sources"]))
