"""Taking down public queries: one table of requests becomes outcomes, a log, new heads and closed reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.operators.visibility import public

#: Characters of a reason that the log keeps; fixed value.
MAX_REASON = 2000


@dataclass(frozen=True)
class TakenDown:
    """outcomes: every request with its outcome; log: an entry for each head taken down; heads and reports as they are afterwards."""

    outcomes: DataFrame
    log: DataFrame
    heads: DataFrame
    reports: DataFrame


def take_down(requests: DataFrame, users: DataFrame, heads: DataFrame, reports: DataFrame) -> TakenDown:
    """Applies all requests (request_id, doc_id, admin_id, reason, at) at once.

    outcome is ADMIN_REQUIRED where the user is no administrator, ``unpublished`` for the first
    request of an administrator (by time, then id) for a public head, and PUBLIC_QUERY_NOT_FOUND
    else: for later ones the head is no longer public. The first one is a minimum that is combined before the shuffle, however often
    a head is asked for. Open reports on a head taken down become ``actioned`` with reviewer and time.
    A null id names nothing. Ids of requests, users and heads are unique; repeated users count once.
    """
    admins = users.where("role = 'admin'").select(F.col("user_id").alias("admin_id"), F.lit(True).alias("_admin")).distinct()
    shown = heads.where(public()).select("doc_id", F.col("visibility").alias("_was"))
    asked = requests.join(admins, "admin_id", "left").join(shown, "doc_id", "left")
    fit = F.coalesce("_admin", F.lit(False)) & F.col("_was").isNotNull()
    first = asked.where(fit).groupBy("doc_id").agg(F.min(F.struct("at", "request_id", "admin_id")).alias("_first"))
    judged = asked.join(first, "doc_id", "left")
    won = F.coalesce(F.col("_first.request_id") == F.col("request_id"), F.lit(False))
    outcome = F.when(~F.coalesce("_admin", F.lit(False)), "ADMIN_REQUIRED").when(won, "unpublished").otherwise("PUBLIC_QUERY_NOT_FOUND")
    outcomes = judged.select(*requests.columns, outcome.alias("outcome"))
    log = judged.where(won).select(
        "request_id", "doc_id", "admin_id", F.lit("unpublish").alias("action"), F.substring(F.trim(F.coalesce("reason", F.lit(""))), 1, MAX_REASON).alias("reason"), F.col("_was").alias("previous_visibility"), "at",
    )
    done = first.select("doc_id", F.col("_first.admin_id").alias("_by"), F.col("_first.at").alias("_at"))
    taken = F.col("_at").isNotNull()
    changed = heads.join(done, "doc_id", "left").withColumns({
        "moderation_status": F.when(taken, "unpublished").otherwise(F.col("moderation_status")), "updated_at": F.when(taken, F.col("_at")).otherwise(F.col("updated_at")),
    })
    closes = taken & (F.col("status") == "open")
    closed = reports.join(done, "doc_id", "left").withColumns({
        "reviewed_by": F.when(closes, F.col("_by")), "reviewed_at": F.when(closes, F.col("_at")), "status": F.when(closes, "actioned").otherwise(F.col("status")),
    })
    return TakenDown(outcomes, log, changed.select(*heads.columns), closed.select(*reports.columns, "reviewed_by", "reviewed_at"))
