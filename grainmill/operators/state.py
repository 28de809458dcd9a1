"""States derived from facts: stars, reports, moderation, history, versions, outbox and limits.

Nothing is changed in place: each function takes tables and returns what they become.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.operators.visibility import public


def search_history(turns: DataFrame) -> DataFrame:
    """Requests of users, with their time."""
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    at = base + F.make_dt_interval(mins=F.col("conv_id").cast("int"), secs=F.col("turn").cast("decimal(18,6)"))
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return turns.where("role = 'user'").select(key.alias("history_id"), (F.col("conv_id") % 150).alias("user_id"), F.col("text").alias("raw_request"), at.alias("created_at"))


def guarded_clicks(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """A click counts where the user may read what was clicked on."""
    seen = heads.where(~F.col("deleted")).select(F.col("doc_id").alias("d"), F.col("query_id").alias("clicked_query_id"), public().alias("shown"), "owner_id")
    return rows.join(seen, (F.col("doc_id") == F.col("d")) & (F.col("shown") | (F.col("owner_id") == F.col("user_id"))), "left")


def surviving_stars(stars: DataFrame, heads: DataFrame) -> DataFrame:
    """Stars stay on public rows only."""
    return stars.join(heads.where(public()).select("doc_id"), "doc_id", "left_semi")


def open_reports(reports: DataFrame, heads: DataFrame) -> DataFrame:
    """One open report a reporter and row, the first; public rows only."""
    shown = reports.join(heads.where(public()).select("doc_id"), "doc_id", "left_semi")
    first = F.row_number().over(Window.partitionBy("user_id", "doc_id").orderBy("ts", "event_id"))
    return shown.withColumn("k", first).where("k = 1").drop("k")


def unpublish(reports: DataFrame, actioned: DataFrame) -> DataFrame:
    """An unpublished row's open reports become actioned, however often it was actioned."""
    hit = actioned.select("doc_id").distinct().withColumn("hit", F.lit(True))
    marked = reports.join(hit, "doc_id", "left")
    return marked.withColumn("status", F.when(F.col("hit"), "actioned").otherwise("open")).withColumn("moderation_status", F.when(F.col("hit"), "unpublished").otherwise("visible")).drop("hit")


def in_given_order(heads: DataFrame, ids: Sequence[int], most: int = 200) -> DataFrame:
    """The rows of at most ``most`` distinct ids, numbered as given."""
    ids = list(dict.fromkeys(ids))[:most]
    wanted = heads.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids, 1)], "doc_id bigint, place bigint")
    return heads.join(F.broadcast(wanted), "doc_id")  # at most 200 rows


# ---- versions


def next_numbers(queries: DataFrame, versions: DataFrame) -> DataFrame:
    """The next version number of each query."""
    top = versions.groupBy("query_id").agg(F.max("version_number").alias("top"))
    return queries.join(top, "query_id", "left").select("query_id", (F.coalesce("top", F.lit(0)) + 1).cast("long").alias("next_number"))


def merged_versions(versions: DataFrame, incoming: DataFrame) -> DataFrame:
    """Versions after a batch: content that a query does not have yet becomes its next version.

    ``versions`` has query_id, version_number and content_hash; ``incoming`` query_id and content_hash. A
    hash that comes again, in the batch or from before, adds nothing.
    """
    new = incoming.select("query_id", "content_hash").distinct().join(versions, ["query_id", "content_hash"], "left_anti")
    top = versions.groupBy("query_id").agg(F.max("version_number").alias("top"))
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("content_hash"))
    added = new.join(top, "query_id", "left").select("query_id", (F.coalesce("top", F.lit(0)) + number).cast("long").alias("version_number"), "content_hash")
    return versions.select("query_id", "version_number", "content_hash").unionByName(added)


def merged_heads(heads: DataFrame, versions: DataFrame, incoming: DataFrame) -> DataFrame:
    """The current version moves forward only, or to the incoming one where the query was deleted."""
    target = incoming.select("query_id", "content_hash").join(versions, ["query_id", "content_hash"]).groupBy("query_id").agg(F.max("version_number").alias("to"))
    out = heads.join(target, "query_id", "full")
    current, to = F.col("current_number"), F.col("to")
    moved = F.when(to.isNull(), current).when(current.isNull() | F.coalesce("deleted", F.lit(False)), to).otherwise(F.greatest(current, to))
    return out.select("query_id", moved.cast("long").alias("current_number"), F.when(to.isNull(), F.coalesce("deleted", F.lit(False))).otherwise(F.lit(False)).alias("deleted"))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows by key; new values replace old ones. Of new rows that repeat a key the last by all columns counts; old keys are unique."""
    cols = [c for c in old.columns if c != key]
    last = new.groupBy(key).agg(F.max(F.struct(*cols)).alias("_row")).select(key, *(F.col("_row")[c].alias(c) for c in cols), F.lit(True).alias("has_new"))
    joined = old.select(key, *(F.col(c).alias(f"{c}_old") for c in cols), F.lit(True).alias("has_old")).join(last, key, "full")
    return joined.select(key, *(F.when(F.col("has_new"), F.col(c)).otherwise(F.col(f"{c}_old")).alias(c) for c in cols))


def obsolete(existing: DataFrame, processed: DataFrame, accepted: DataFrame) -> DataFrame:
    """Un-owned rows of processed paths that the import no longer has."""
    return existing.where("owner_id is null").join(processed.select("path").distinct(), "path", "left_semi").join(accepted.select("query_id"), "query_id", "left_anti")


# ---- outbox


def outbox_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Jobs that bring a vector index from one state of the heads to another.

    Both have query_id, version_id, visibility, owner_id and live. Where the version, the
    namespace or being live changes, the old vector is deleted and the new one, if live, upserted.
    """
    side = lambda df, s: df.select("query_id", *(F.col(c).alias(f"{c}_{s}") for c in ("version_id", "visibility", "owner_id", "live")))
    both = side(before, "o").join(side(after, "n"), "query_id", "full")
    ns = lambda s: F.when(F.col(f"visibility_{s}") == "public", "public").otherwise("private")
    owner = lambda s: F.when(F.col(f"visibility_{s}") != "public", F.col(f"owner_id_{s}"))
    was, now = F.coalesce("live_o", F.lit(False)), F.coalesce("live_n", F.lit(False))
    same = F.col("version_id_o").eqNullSafe(F.col("version_id_n")) & ns("o").eqNullSafe(ns("n")) & owner("o").eqNullSafe(owner("n")) & (was == now)
    job = lambda s, op: F.struct(F.col(f"version_id_{s}").alias("version_id"), F.lit(op).alias("operation"), ns(s).alias("namespace_kind"), owner(s).alias("owner_id"))
    jobs = F.array_compact(F.array(F.when(was, job("o", "delete")), F.when(now, job("n", "upsert"))))
    return both.where(~same).select("query_id", F.explode(jobs).alias("j")).select("query_id", "j.*")


def claim(jobs: DataFrame, now: Column, limit: int = 10, lease: str = "5 minutes") -> DataFrame:
    """The next jobs to work on: due ones, and those whose worker's lease has run out."""
    due = (F.col("available_at") <= now) & (F.col("status").isin("pending", "failed") | ((F.col("status") == "processing") & (F.col("locked_at") < now - F.expr(f"interval {lease}"))))
    return jobs.where(due).orderBy("available_at", "created_at", "job_id").limit(max(1, min(100, limit))).withColumn("attempts", F.col("attempts") + 1)


def prepared(jobs: DataFrame, heads: DataFrame) -> DataFrame:
    """What each job does now: a job whose version, namespace or owner is no longer current becomes a delete."""
    h = heads.select("query_id", F.col("version_id").alias("cv"), F.col("visibility").alias("vis"), F.col("owner_id").alias("own"))
    right = F.when(F.col("namespace_kind") == "public", F.col("vis") == "public").otherwise((F.col("vis") == "private") & (F.col("owner_id") == F.col("own")))
    fits = F.coalesce((F.col("cv") == F.col("version_id")) & right, F.lit(False))
    action = F.when((F.col("operation") == "upsert") & fits, "upsert").otherwise("delete")
    return jobs.join(h, "query_id", "left").withColumn("action", action).drop("cv", "vis", "own")


def namespace(kind: Column, owner: Column) -> Column:
    return F.when(kind == "public", "public").otherwise(F.concat(F.lit("private:"), owner.cast("string")))


def vector_id(space: Column, version_id: Column) -> Column:
    """SHA-256 of namespace, NUL and version id."""
    return F.sha2(F.concat(space, F.char(F.lit(0)), version_id), 256)


def retried(jobs: DataFrame, now: Column, delay_seconds: int = 30, code: str = "failed") -> DataFrame:
    """Failed jobs come back after a delay of 1 second to a day; codes have 256 characters at most."""
    wait = max(1, min(86400, delay_seconds))
    return jobs.withColumns({"status": F.lit("failed"), "available_at": now + F.expr(f"interval {wait} seconds"), "failure_code": F.lit(code[:256]), "locked_at": F.lit(None).cast("timestamp_ntz")})


def rate_buckets(events: DataFrame, most: int = 10, window: str = "60 seconds") -> DataFrame:
    """Requests of each actor in fixed windows; the first ``most`` of a window pass."""
    n = events.groupBy("user_id", F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return n.select("user_id", F.col("w.start").alias("window_start"), "requests", F.greatest(F.lit(0), F.col("requests") - most).alias("refused"))


def completed(jobs: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """Jobs of ``done`` (job_id) are completed and give their lease back; others stay as they are."""
    marked = jobs.join(done.select("job_id", F.lit(True).alias("done")).distinct(), "job_id", "left")
    return marked.withColumns({
        "status": F.when(F.col("done"), "completed").otherwise(F.col("status")), "locked_at": F.when(F.col("done"), F.lit(None).cast("timestamp_ntz")).otherwise(F.col("locked_at")),
        "completed_at": F.when(F.col("done"), now),
    }).drop("done")


def moderation_log(actions: DataFrame, users: DataFrame) -> DataFrame:
    """Actions (doc_id, user_id) of administrators; those of others leave no trace."""
    return actions.join(users.where("role = 'admin'").select("user_id"), "user_id", "left_semi").select("doc_id", "user_id", F.lit("unpublish").alias("action"))
