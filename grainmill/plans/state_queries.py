"""Version merges, outbox, limits and the audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.operators import audit, retrieval, state
from grainmill.plans.catalogue import query
from grainmill.sources import corpus
from grainmill.sources.corpus import SQL

#: A query is a source's documents of one remainder; versions are its distinct texts by id.
VERSIONS = """v0 AS (SELECT source || '-' || CAST(doc_id % 50 AS VARCHAR) AS query_id, substr(sha256(text), 1, 16) AS content_hash, min(doc_id) AS first_id FROM documents GROUP BY 1, 2),
versions AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY first_id) AS version_number, content_hash FROM v0 WHERE first_id % 3 <> 0),
incoming AS (SELECT query_id, content_hash FROM v0 WHERE first_id % 2 = 0)"""


def _versions(spark, sf_dir):
    from pyspark.sql import Window

    d = corpus.read(spark, sf_dir, "documents")
    key = F.concat(F.col("source"), F.lit("-"), (F.col("doc_id") % 50).cast("string"))
    v0 = d.groupBy(key.alias("query_id"), F.substring(F.sha2("text", 256), 1, 16).alias("content_hash")).agg(F.min("doc_id").alias("first_id"))
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("first_id"))
    old = v0.where("first_id % 3 <> 0").select("query_id", number.cast("long").alias("version_number"), "content_hash")
    return old, v0.where("first_id % 2 = 0").select("query_id", "content_hash")


MERGED = f"""{VERSIONS}, top AS (SELECT query_id, max(version_number) AS top FROM versions GROUP BY 1),
fresh AS (SELECT DISTINCT i.query_id, i.content_hash FROM incoming i LEFT JOIN versions v USING (query_id, content_hash) WHERE v.version_number IS NULL),
merged AS (SELECT * FROM versions UNION ALL SELECT f.query_id, coalesce(top, 0) + row_number() OVER (PARTITION BY f.query_id ORDER BY f.content_hash), f.content_hash FROM fresh f LEFT JOIN top USING (query_id))"""


@query(f"WITH {VERSIONS}, q AS (SELECT DISTINCT query_id FROM v0) SELECT q.query_id, coalesce(max(version_number), 0) + 1 AS next_number FROM q LEFT JOIN versions USING (query_id) GROUP BY 1")
def next_version_number(spark, sf_dir):
    d = corpus.read(spark, sf_dir, "documents")
    ids = d.select(F.concat(F.col("source"), F.lit("-"), (F.col("doc_id") % 50).cast("string")).alias("query_id")).distinct()
    return state.next_numbers(ids, _versions(spark, sf_dir)[0])


@query(f"WITH {MERGED} SELECT * FROM merged")
def version_merge(spark, sf_dir):
    return state.merged_versions(*_versions(spark, sf_dir))


@query(f"""WITH {MERGED}, h AS (SELECT query_id, max(version_number) AS cur, hash_mod = 0 AS deleted FROM (SELECT *, strlen(query_id) % 2 AS hash_mod FROM versions) GROUP BY query_id, hash_mod),
    t AS (SELECT i.query_id, max(m.version_number) AS target FROM incoming i JOIN merged m USING (query_id, content_hash) GROUP BY 1)
    SELECT query_id, CASE WHEN target IS NULL THEN cur WHEN cur IS NULL OR deleted THEN target ELSE greatest(cur, target) END AS current_number, CASE WHEN target IS NULL THEN coalesce(deleted, false) ELSE false END AS deleted FROM h FULL JOIN t USING (query_id)""")
def head_merge(spark, sf_dir):
    old, incoming = _versions(spark, sf_dir)
    heads = old.groupBy("query_id").agg(F.max("version_number").alias("current_number")).withColumn("deleted", F.octet_length("query_id") % 2 == 0)
    return state.merged_heads(heads, state.merged_versions(old, incoming), incoming)


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'NEW-' || s_name ELSE s_name END AS s_name, CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE s_nationkey END AS s_nationkey FROM supplier
    UNION ALL SELECT n_nationkey + 1000000, n_name, n_nationkey FROM nation""")
def upsert_dimension(spark, sf_dir):
    old = corpus.read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    new = old.where("s_suppkey % 4 = 0").select("s_suppkey", F.concat(F.lit("NEW-"), "s_name").alias("s_name"), F.lit(1).alias("s_nationkey"))
    more = corpus.read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1000000).cast("long").alias("s_suppkey"), F.col("n_name").alias("s_name"), F.col("n_nationkey").alias("s_nationkey"))
    return state.upserted(old, new.unionByName(more), "s_suppkey")


@query(f"""WITH {SQL} SELECT query_id FROM corpus WHERE doc_id % 9 <> 0 AND doc_id % 4 <> 1 AND repository IN (SELECT repository FROM corpus WHERE doc_id % 100 = 3)""")
def obsolete_blocks(spark, sf_dir):
    d = corpus.documents(spark, sf_dir)
    existing = d.select("query_id", F.col("repository").alias("path"), F.when(F.col("doc_id") % 9 == 0, F.col("owner_id")).alias("owner_id"))
    processed = d.where("doc_id % 100 = 3").select(F.col("repository").alias("path"))
    return state.obsolete(existing, processed, d.where("doc_id % 4 = 1").select("query_id")).select("query_id")


AFTER = """aft AS (SELECT query_id, CASE WHEN doc_id % 5 = 0 THEN query_id || '-v2' ELSE version_id END AS version_id, CASE WHEN doc_id % 7 = 0 THEN 'private' ELSE visibility END AS visibility, owner_id, doc_id % 11 <> 0 AS live FROM corpus WHERE doc_id % 13 <> 0),
bef AS (SELECT query_id, version_id, visibility, owner_id, true AS live FROM corpus WHERE doc_id % 17 <> 0),
d AS (SELECT coalesce(b.query_id, a.query_id) AS query_id, b.version_id AS bv, a.version_id AS av, CASE WHEN b.visibility = 'public' THEN 'public' ELSE 'private' END AS bn, CASE WHEN a.visibility = 'public' THEN 'public' ELSE 'private' END AS an,
  CASE WHEN b.visibility <> 'public' THEN b.owner_id END AS bo, CASE WHEN a.visibility <> 'public' THEN a.owner_id END AS ao, coalesce(b.live, false) AS bl, coalesce(a.live, false) AS al FROM bef b FULL JOIN aft a ON a.query_id = b.query_id),
c AS (SELECT * FROM d WHERE NOT (bv IS NOT DISTINCT FROM av AND bn = an AND bo IS NOT DISTINCT FROM ao AND bl = al)),
jobs AS (SELECT query_id, bv AS version_id, 'delete' AS operation, bn AS namespace_kind, bo AS owner_id FROM c WHERE bl UNION ALL SELECT query_id, av, 'upsert', an, ao FROM c WHERE al)"""


def _states(spark, sf_dir):
    h = corpus.labelled(corpus.documents(spark, sf_dir), spark, sf_dir)
    before = h.where("doc_id % 17 <> 0").select("query_id", "version_id", "visibility", "owner_id", F.lit(True).alias("live"))
    after = h.where("doc_id % 13 <> 0").select(
        "query_id", F.when(F.col("doc_id") % 5 == 0, F.concat("query_id", F.lit("-v2"))).otherwise(F.col("version_id")).alias("version_id"),
        F.when(F.col("doc_id") % 7 == 0, "private").otherwise(F.col("visibility")).alias("visibility"), "owner_id", (F.col("doc_id") % 11 != 0).alias("live"),
    )
    return before, after


@query(f"WITH {SQL}, {AFTER} SELECT * FROM jobs")
def outbox_diff(spark, sf_dir):
    return state.outbox_diff(*_states(spark, sf_dir))


@query(f"""WITH {SQL}, {AFTER} SELECT j.query_id, j.version_id, j.operation, CASE WHEN j.operation = 'upsert' AND c.version_id = j.version_id AND (CASE WHEN j.namespace_kind = 'public' THEN c.visibility = 'public' ELSE c.visibility = 'private' AND c.owner_id = j.owner_id END)
    THEN 'upsert' ELSE 'delete' END AS action, sha256((CASE WHEN j.namespace_kind = 'public' THEN 'public' ELSE 'private:' || CAST(j.owner_id AS VARCHAR) END) || chr(0) || j.version_id) AS vector_id FROM jobs j LEFT JOIN corpus c ON c.query_id = j.query_id""")
def stale_jobs(spark, sf_dir):
    jobs = state.outbox_diff(*_states(spark, sf_dir))
    heads = corpus.labelled(corpus.documents(spark, sf_dir), spark, sf_dir)
    out = state.prepared(jobs, heads)
    space = state.namespace(F.col("namespace_kind"), F.col("owner_id"))
    return out.select("query_id", "version_id", "operation", "action", state.vector_id(space, F.col("version_id")).alias("vector_id"))


JOBS = """j AS (SELECT CAST(event_id AS VARCHAR) AS job_id, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' ELSE 'done' END AS status, ts AS available_at, ts AS created_at, ts + to_minutes(event_id % 10) AS locked_at, event_id % 3 AS attempts, (SELECT max(ts) FROM events) AS now FROM events)"""


@query(f"""WITH {JOBS} SELECT job_id, attempts + 1 AS attempts FROM j WHERE available_at <= now AND (status IN ('pending', 'failed') OR (status = 'processing' AND locked_at < now - INTERVAL 5 MINUTE))
    ORDER BY available_at, created_at, job_id LIMIT 100""")
def outbox_claim(spark, sf_dir):
    e = corpus.read(spark, sf_dir, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    status = F.element_at(F.array(*map(F.lit, ["pending", "processing", "failed", "done"])), (F.col("event_id") % 4 + 1).cast("int"))
    jobs = e.select(F.col("event_id").cast("string").alias("job_id"), status.alias("status"), F.col("ts").alias("available_at"), F.col("ts").alias("created_at"),
                    (F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 10).cast("int"))).alias("locked_at"), (F.col("event_id") % 3).alias("attempts"))
    return state.claim(jobs, now, 100).select("job_id", "attempts")


@query(f"""SELECT user_id, {corpus.SQL_ISO.format("time_bucket(INTERVAL '60 seconds', ts)")} AS window_start, count(*) AS requests, greatest(0, count(*) - 10) AS refused FROM events GROUP BY user_id, time_bucket(INTERVAL '60 seconds', ts)""")
def rate_limit_buckets(spark, sf_dir):
    return state.rate_buckets(corpus.read(spark, sf_dir, "events")).select("user_id", F.date_format("window_start", corpus.ISO).alias("window_start"), "requests", "refused")


INDEX = """idx AS (SELECT query_id, CASE WHEN doc_id % 19 = 0 THEN title || ' x' ELSE title END AS title, repository FROM corpus WHERE doc_id % 23 <> 0 UNION ALL SELECT query_id, title, repository FROM corpus WHERE doc_id % 29 = 0 AND doc_id % 23 <> 0
  UNION ALL SELECT query_id || '-gone', title, repository FROM corpus WHERE doc_id % 31 = 0)"""


def _index(spark, sf_dir):
    d = corpus.documents(spark, sf_dir).select("doc_id", "query_id", "title", "repository")
    base = d.where("doc_id % 23 <> 0").withColumn("title", F.when(F.col("doc_id") % 19 == 0, F.concat("title", F.lit(" x"))).otherwise(F.col("title")))
    gone = d.where("doc_id % 31 = 0").withColumn("query_id", F.concat("query_id", F.lit("-gone")))
    return d.drop("doc_id"), base.unionByName(d.where("doc_id % 29 = 0 and doc_id % 23 <> 0")).unionByName(gone).drop("doc_id")


RECONCILED = f"""{INDEX}, g AS (SELECT query_id, count(*) AS n, min(title) AS title, min(repository) AS repository FROM idx GROUP BY 1),
rec AS (SELECT coalesce(c.query_id, g.query_id) AS query_id, CASE WHEN c.query_id IS NULL THEN 'index-unexpected' WHEN g.query_id IS NULL THEN 'index-missing' WHEN n <> 1 OR c.title IS DISTINCT FROM g.title OR c.repository IS DISTINCT FROM g.repository THEN 'index-mismatch' END AS code FROM corpus c FULL JOIN g ON c.query_id = g.query_id)"""


@query(f"WITH {SQL}, {RECONCILED} SELECT query_id, code FROM rec WHERE code = 'index-missing'")
def audit_missing(spark, sf_dir):
    return audit.reconciled(*_index(spark, sf_dir)).where("code = 'index-missing'")


@query(f"WITH {SQL}, {RECONCILED} SELECT query_id, code FROM rec WHERE code = 'index-mismatch'")
def audit_mismatch(spark, sf_dir):
    return audit.reconciled(*_index(spark, sf_dir)).where("code = 'index-mismatch'")


@query(f"WITH {SQL}, {RECONCILED} SELECT query_id, code FROM rec WHERE code = 'index-unexpected'")
def audit_unexpected(spark, sf_dir):
    return audit.reconciled(*_index(spark, sf_dir)).where("code = 'index-unexpected'")


@query(f"""WITH {SQL} SELECT query_id, first_id FROM (SELECT query_id, row_number() OVER w AS k, first_value(query_id) OVER w AS first_id FROM corpus WHERE trim(title) <> '' WINDOW w AS (PARTITION BY lower(repository), lower(trim(title)) ORDER BY query_id)) WHERE k > 1""")
def duplicate_titles(spark, sf_dir):
    return audit.duplicate_titles(corpus.documents(spark, sf_dir)).select("query_id", "first_id")


@query(f"""WITH {SQL}, x AS (SELECT query_id, 'empty-description' AS code FROM corpus WHERE trim(description) = '' UNION ALL SELECT query_id, 'empty-tags' FROM corpus WHERE len(tags) = 0 UNION ALL SELECT query_id, 'tableless' FROM corpus WHERE len(tables) = 0
    UNION ALL SELECT query_id, 'dangling-version' FROM corpus WHERE doc_id % 37 = 0) SELECT code, count(*) AS n FROM x GROUP BY code""")
def audit_findings(spark, sf_dir):
    d = corpus.documents(spark, sf_dir).withColumn("version_known", F.col("doc_id") % 37 != 0)
    found = audit.findings(d)
    return found.where("code in ('empty-description', 'empty-tags', 'tableless', 'dangling-version')").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query()
def index_reconciles(spark, sf_dir):
    """The index of a state against itself: no finding."""
    docs = retrieval.index_documents(corpus.documents(spark, sf_dir)).drop("doc_id", "kql")
    return audit.reconciled(docs, docs)


@query()
def outbox_stream(spark, sf_dir):
    from grainmill.streaming import outbox

    return outbox.replay(spark, sf_dir)


@query("""WITH j AS (SELECT event_id AS job_id, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type = 'click')
    SELECT job_id, action, CAST(attempts AS INTEGER) AS attempts, reason, ms + after AS at_ms FROM j, (VALUES
      (0, 'due', 0, 'new', 0), (0, 'completed', 1, '', 2000), (1, 'due', 0, 'new', 0), (1, 'due', 1, 'lease-expired', 301000), (1, 'completed', 2, '', 303000),
      (2, 'due', 0, 'new', 0), (2, 'due', 1, 'retry', 32000), (2, 'completed', 2, '', 34000), (3, 'due', 0, 'new', 0), (3, 'due', 1, 'lease-expired', 301000)) c(rest, action, attempts, reason, after) WHERE job_id % 4 = rest""")
def lease_stream(spark, sf_dir):
    from grainmill.streaming import leases

    return leases.replay(spark, sf_dir)
