"""Authored queries: what a table of requests makes of the heads. All set-based, one row a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.functions import text as t
from grainmill.functions.query_text import strip, structural_problem
from grainmill.operators.visibility import public

#: Fields that every version has.
CONTENT = ["title", "kql", "description", "dialect", "tables", "operators", "tags"]
#: Fields that a version may lack: a text, and lists.
MORE = ["explanation", "assumptions", "validation_warnings"]


def content_hash(rows: DataFrame | None = None) -> Column:
    """SHA-256 of a version's content, ten keys in a fixed order: white space around texts and the kind of line breaks do not matter; fields that ``rows`` lacks (without it, those of MORE) are empty."""
    more = [c for c in MORE if rows is not None and c in rows.columns]
    text = lambda c: strip(F.coalesce(c, F.lit("")))
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in more else F.array().cast("array<string>")
    return t.content_hash(
        title=text(F.col("title")), kql=F.regexp_replace(text(F.col("kql")), "\\r\\n?", "\n"), description=text(F.col("description")), explanation=text(F.col("explanation")) if "explanation" in more else F.lit(""),
        dialect=F.col("dialect"), tables=F.col("tables"), operators=F.col("operators"), tags=F.col("tags"), assumptions=listed("assumptions"), validationWarnings=listed("validation_warnings"),
    )


def problems() -> Column:
    """Why a query cannot be saved: title of 1 to 180 characters, body of 1 to 100,000."""
    title, body = F.length(F.trim("title")), F.length(F.trim("kql"))
    return F.array_compact(F.array(
        F.when(title.isNull() | (title < 1), "title-missing"), F.when(title > 180, "title-too-long"), F.when(body.isNull() | (body < 1), "body-missing"), F.when(body > 100_000, "body-too-long"),
    ))


def created(requests: DataFrame, now: Column) -> DataFrame:
    """First versions of new queries; requests with problems are left out."""
    return requests.where(F.size(problems()) == 0).withColumns({"version_number": F.lit(1).cast("long"), "content_hash": content_hash(requests), "created_at": now})


def updated(current: DataFrame, edits: DataFrame, at: str | None = None) -> DataFrame:
    """New versions from owners' edits: content equal to the version before makes none.

    ``current`` has query_id, owner_id, version_number and content_hash, ``edits`` query_id, editor and the content fields. Several edits of one query
    are taken in the order of ``at`` (without it, and among equal times, in the order of their content hashes) and numbered one after the other.
    """
    known = current.select("query_id", "owner_id", "version_number", F.col("content_hash").alias("old_hash"))
    fields = CONTENT + [c for c in MORE if c in edits.columns]
    made = edits.select("query_id", "editor", *fields, (F.col(at) if at else F.lit(None)).alias("_at"), content_hash(edits).alias("content_hash")).join(known, "query_id")
    by = Window.partitionBy("query_id").orderBy("_at", "content_hash")
    own = made.where(F.col("editor") == F.col("owner_id")).withColumn("_before", F.coalesce(F.lag("content_hash").over(by), "old_hash"))
    rows = own.where(~F.col("content_hash").eqNullSafe(F.col("_before"))).withColumn("_nth", F.row_number().over(by))
    return rows.select("query_id", (F.col("version_number") + F.col("_nth")).alias("version_number"), "content_hash", *fields)


def with_visibility(heads: DataFrame, wishes: DataFrame, now: Column) -> DataFrame:
    """Sets visibility where the owner asks; the time of first publication stays; a body with a structural problem stays private."""
    w = wishes.select("query_id", F.col("visibility").alias("wish"), F.col("owner_id").alias("by"))
    rows = heads.join(w, "query_id", "left")
    asked = F.coalesce(F.col("by") == F.col("owner_id"), F.lit(False)) & ((F.col("wish") == "private") | structural_problem(F.col("kql")).isNull())
    shown = F.when(asked, F.col("wish")).otherwise(F.col("visibility"))
    published = F.coalesce("published_at", F.when(shown == "public", now))
    return rows.withColumns({"published_at": published, "visibility": shown}).drop("wish", "by")


def soft_deleted(heads: DataFrame, deletions: DataFrame, now: Column) -> DataFrame:
    """Owners' deletions mark a row, and make it private."""
    d = deletions.select("query_id", F.col("owner_id").alias("by"))
    rows = heads.join(d, "query_id", "left")
    gone = F.coalesce(F.col("by") == F.col("owner_id"), F.lit(False))
    return rows.withColumns({"deleted_at": F.when(gone, F.coalesce("deleted_at", now)).otherwise(F.col("deleted_at")), "visibility": F.when(gone, "private").otherwise(F.col("visibility"))}).drop("by")


def starred(stars: DataFrame, new: DataFrame, heads: DataFrame) -> DataFrame:
    """Stars after new ones on public rows; a star that is there stays one."""
    allowed = new.join(heads.where(public()).select("doc_id"), "doc_id", "left_semi")
    return stars.select("user_id", "doc_id").unionByName(allowed.select("user_id", "doc_id")).distinct()


def unstarred(stars: DataFrame, gone: DataFrame) -> DataFrame:
    return stars.join(gone.select("user_id", "doc_id"), ["user_id", "doc_id"], "left_anti")


def violations(heads: DataFrame, versions: DataFrame, stars: DataFrame) -> DataFrame:
    """Rows (rule, id) that break an invariant: current version of another query, stars on rows that are not public, two versions of one number."""
    v = versions.select("version_id", F.col("query_id").alias("of"))
    foreign = heads.join(v, "version_id", "left").where(~F.col("of").eqNullSafe(F.col("query_id"))).select(F.lit("current-version").alias("rule"), F.col("query_id").alias("id"))
    hidden = stars.join(heads.where("visibility <> 'public'").select("doc_id"), "doc_id", "left_semi").select(F.lit("star-on-private").alias("rule"), F.col("doc_id").cast("string").alias("id"))
    twice = versions.groupBy("query_id", "version_number").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("version-number").alias("rule"), F.col("query_id").alias("id"))
    return foreign.unionByName(hidden).unionByName(twice)
