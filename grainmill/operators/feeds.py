"""Detail and list projections, and keyset-paged feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.operators.visibility import after, clamp_limit, feed_rule, public, readable
from grainmill.sources.corpus import ISO


def iso(column: str) -> Column:
    return F.date_format(column, ISO)


def snippet() -> Column:
    """The description's start, or the body's where it is blank."""
    return F.when(F.length(F.trim("description")) > 0, F.substring("description", 1, 360)).otherwise(F.substring("kql", 1, 360))


def preview_description() -> Column:
    """The description, else the first 480 characters of the body with white space collapsed."""
    preview = F.trim(F.regexp_replace(F.substring("kql", 1, 480), "[ \\t\\r\\n]+", " "))
    return F.coalesce(F.nullif(F.trim("description"), F.lit("")), preview)


def with_star_flag(heads: DataFrame, stars: DataFrame, viewer: int) -> DataFrame:
    """Mark join: whether the viewer has starred the row."""
    own = stars.where(F.col("user_id") == viewer).select("doc_id", F.lit(True).alias("marked"))
    return heads.join(own, "doc_id", "left").withColumn("starred_by_viewer", F.col("marked").isNotNull()).drop("marked")


def provenance() -> Column:
    """Null unless the repository is known."""
    return F.when(F.col("repository").isNotNull(), F.struct(F.col("repository").alias("name"), F.concat(F.lit("https://host.example/"), F.col("repository")).alias("url"), "trusted"))


def detail(heads: DataFrame, stars: DataFrame, viewer: int) -> DataFrame:
    return with_star_flag(heads.where(readable(viewer)), stars, viewer)


def owned(heads: DataFrame, owner: int, cursor: tuple | None = None, limit: int | None = None, visibility: str | None = None) -> DataFrame:
    """The owner's rows, newest first; one row more than the limit tells that a page follows."""
    rows = heads.where((F.col("owner_id") == owner) & ~F.col("deleted"))
    if visibility:
        rows = rows.where(F.col("visibility") == visibility)
    return _page(rows, ["updated_at", "query_id"], cursor, clamp_limit(limit))


def public_feed(heads: DataFrame, cursor: tuple | None = None, limit: int | None = None) -> DataFrame:
    """Rows of the feed rule by stars, then newest first; heads without a provider column have rows of owners only."""
    rule = feed_rule("provider" if "provider" in heads.columns else F.lit(None).cast("string"))
    return _page(heads.where(rule), ["star_count", "updated_at", "query_id"], cursor, clamp_limit(limit, 20))


def starred(heads: DataFrame, stars: DataFrame, user: int, cursor: tuple | None = None, limit: int | None = None) -> DataFrame:
    """Public rows that a user has starred."""
    rows = heads.where(public()).join(stars.where(F.col("user_id") == user).select("doc_id"), "doc_id")
    return _page(rows, ["updated_at", "query_id"], cursor, clamp_limit(limit))


def history(turns: DataFrame, cursor: tuple | None = None, limit: int | None = None) -> DataFrame:
    """A user's searches, newest first."""
    return _page(turns, ["created_at", "history_id"], cursor, clamp_limit(limit))


def _page(rows: DataFrame, keys: list[str], cursor: tuple | None, limit: int) -> DataFrame:
    if cursor is not None:
        rows = rows.where(after(list(zip(keys, cursor, strict=True))))
    return rows.orderBy(*(F.desc(k) for k in keys)).limit(limit + 1)


def sitemap(heads: DataFrame, limit: int = 50_000) -> DataFrame:
    return heads.where(public()).orderBy(F.desc("updated_at"), F.desc("query_id")).limit(limit).select("query_id", "updated_at")
