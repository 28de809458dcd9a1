"""Guards, totals, spellings and settled jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions import text as t
from grainmill.operators import ingest, retrieval, state
from grainmill.operators.feeds import iso
from grainmill.plans.catalogue import query
from grainmill.plans.ingest_queries import GATED, _files
from grainmill.sources import corpus
from grainmill.sources.corpus import SQL

NOW = "2024-06-01 00:00:00"


@query("SELECT doc_id, sha256(text) AS text_hash FROM documents")
def base64_files(spark, sf_dir):
    packed = F.base64(F.encode("text", "utf-8"))
    return corpus.read(spark, sf_dir, "documents").select("doc_id", F.sha2(ingest.decoded_file(packed), 256).alias("text_hash"))


@query("""SELECT page_id, CASE WHEN kind NOT IN ('blob', 'tree', 'commit') THEN 'type' WHEN NOT regexp_full_match(sha, '[0-9a-f]{40,64}') THEN 'sha' WHEN NOT regexp_matches(url, '^https://[^\\s/?#]+') THEN 'url' END AS reason
    FROM (SELECT page_id, url, substr(sha256(coalesce(html, '')), 1, 30 + length(url) % 40) AS sha, CASE WHEN length(url) % 7 = 0 THEN 'link' ELSE 'blob' END AS kind FROM pages)""")
def tree_entry_shapes(spark, sf_dir):
    p = corpus.read(spark, sf_dir, "pages")
    n = F.length("url")
    sha = F.substr(F.sha2(F.coalesce("html", F.lit("")), 256), F.lit(1), 30 + n % 40)
    return ingest.checked_entries(p.select("page_id", "url", sha.alias("sha"), F.when(n % 7 == 0, "link").otherwise("blob").alias("type"))).select("page_id", "reason")


REQUIRED = ["documents", "events", "labels", "pages", "embeddings", "conversations", "benchmark"]


@query(f"SELECT {len(REQUIRED)} AS required, {len(REQUIRED)} - count(*) AS missing FROM information_schema.tables WHERE table_name IN ({', '.join(repr(x) for x in REQUIRED)})")
def catalogue_check(spark, sf_dir):
    for name in REQUIRED:
        corpus.read(spark, sf_dir, name).createOrReplaceTempView(name)
    missing = len(ingest.missing_tables(spark, REQUIRED))
    return spark.range(1).select(F.lit(len(REQUIRED)).alias("required"), F.lit(missing).cast("long").alias("missing"))


@query(f"""WITH {SQL}, {GATED} SELECT repository, CAST(sum(CASE WHEN skip_reason IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS accepted, CAST(sum(CASE WHEN skip_reason IS NULL AND length(kql) % 3 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS inserted,
    CAST(sum(CASE WHEN skip_reason IS NULL AND length(kql) % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS unchanged, CAST(sum(CASE WHEN skip_reason IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS skipped FROM gated GROUP BY repository""")
def import_totals(spark, sf_dir):
    known = corpus.documents(spark, sf_dir).where(F.length("kql") % 3 == 0)
    return ingest.import_totals(ingest.gated_files(_files(spark, sf_dir)), known)


@query(f"WITH {SQL}, {GATED} SELECT CAST(count(*) AS BIGINT) AS findings FROM gated WHERE skip_reason IS NOT NULL")
def total_findings(spark, sf_dir):
    counts = ingest.skip_histogram(ingest.gated_files(_files(spark, sf_dir))).where("code <> 'accepted'")
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("findings"))


@query(f"""WITH {SQL}, r AS (SELECT repository, first(spdx) AS spdx FROM (SELECT repository, max(CASE WHEN length(repository) % 2 = 0 THEN 'MIT' ELSE 'GPL-3.0' END) AS spdx FROM corpus GROUP BY repository) GROUP BY repository)
    SELECT repository FROM r WHERE spdx IN ({", ".join(f"'{x}'" for x in t.APPROVED_LICENSES)})""")
def license_guard(spark, sf_dir):
    repos = corpus.documents(spark, sf_dir).groupBy("repository").agg(F.max(F.when(F.length("repository") % 2 == 0, "MIT").otherwise("GPL-3.0")).alias("spdx"))
    licenses = spark.createDataFrame([(x, True) for x in t.APPROVED_LICENSES] + [("GPL-3.0", False)], "spdx string, allowed boolean")
    return ingest.licensed(repos, licenses).select("repository")


@query(f"""WITH {SQL}, a AS (SELECT DISTINCT doc_id, user_id FROM report_rows), u AS (SELECT user_id FROM events WHERE event_type = 'signup' GROUP BY user_id HAVING count(*) >= 2)
    SELECT a.doc_id, a.user_id, 'unpublish' AS action FROM a JOIN u USING (user_id)""")
def moderation_log(spark, sf_dir):
    actions = corpus.reports(spark, sf_dir).select("doc_id", "user_id").distinct()
    users = corpus.read(spark, sf_dir, "events").where("event_type = 'signup'").groupBy("user_id").agg(F.when(F.count(F.lit(1)) >= 2, "admin").otherwise("user").alias("role"))
    return state.moderation_log(actions, users)


SPELLED = """w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{9,}')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Za-z]{9,}'), 1) AS i FROM documents),
  g AS (SELECT doc_id, lower(w) AS k, min(i) AS i, arg_min(w, i) AS first_, arg_max(w, i) AS last_ FROM w GROUP BY 1, 2)
  SELECT d.doc_id, sha256(coalesce(string_agg(first_, ',' ORDER BY i), '')) AS first_spellings, sha256(coalesce(string_agg(last_, ',' ORDER BY i), '')) AS last_spellings FROM documents d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id"""


@query(f"WITH {SPELLED}")
def spellings(spark, sf_dir):
    found = corpus.read(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("[A-Za-z]{9,}"), F.lit(0)).alias("w"))
    joined = lambda c: F.sha2(F.coalesce(F.array_join(c, ","), F.lit("")), 256)
    return found.select("doc_id", joined(t.first_spelling(F.col("w"))).alias("first_spellings"), joined(t.last_spelling(F.col("w"))).alias("last_spellings"))


@query("""WITH w AS (SELECT conv_id, turn, ([x for x in regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') if length(x) > 1])[1:16] AS w FROM conversations WHERE role = 'user'),
  u AS (SELECT conv_id, turn, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w), g AS (SELECT conv_id, turn, x, min(i) AS i FROM u GROUP BY ALL)
  SELECT w.conv_id, w.turn, coalesce(string_agg(x, ' ' ORDER BY i), '') AS terms FROM w LEFT JOIN g USING (conv_id, turn) GROUP BY w.conv_id, w.turn""")
def request_terms(spark, sf_dir):
    rows = corpus.read(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", F.array_join(retrieval.terms_of(F.coalesce("text", F.lit(""))), " ").alias("terms"))


@query(f"""WITH {SQL} SELECT query_id, row_number() OVER (ORDER BY place) AS nth FROM (SELECT query_id, visibility, length(kql) % 2 = 0 AS acknowledged, length(title) * 1000000 + doc_id AS place FROM corpus)
    WHERE visibility = 'public' OR acknowledged ORDER BY place LIMIT 5""")
def supporting_context(spark, sf_dir):
    from pyspark.sql import Window

    rows = corpus.labelled(corpus.documents(spark, sf_dir), spark, sf_dir)
    hits = rows.select("query_id", "visibility", (F.length("kql") % 2 == 0).alias("acknowledged"), (F.length("title").cast("long") * 1_000_000 + F.col("doc_id")).alias("place"))
    return retrieval.supporting(hits).select("query_id", F.row_number().over(Window.orderBy("place")).cast("long").alias("nth"))  # five rows


@query(f"""WITH {SQL} SELECT query_id, CASE WHEN star_count >= 3 THEN 409 WHEN deleted THEN 503 WHEN dialect IS NULL OR dialect = 'azure-resource-graph' THEN 422 ELSE 200 END AS status FROM corpus""")
def generation_gate(spark, sf_dir):
    rows = corpus.heads(spark, sf_dir)
    dialect = F.when(F.col("dialect") != "azure-resource-graph", F.col("dialect"))
    return rows.select("query_id", retrieval.generation_gate(F.col("star_count") >= 3, ~F.col("deleted"), dialect).alias("status"))


@query(f"""WITH {SQL} SELECT query_id, regexp_matches(kql, '(^|[^A-Za-z0-9_])' || tables[1] || '($|[^A-Za-z0-9_])') AS whole FROM corpus WHERE len(tables) > 0""")
def identifier_boundary(spark, sf_dir):
    rows = corpus.documents(spark, sf_dir).where(F.size("tables") > 0)
    return rows.select("query_id", t.has_identifier(F.col("kql"), F.col("tables")[0]).alias("whole"))


@query(f"""SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'completed' WHEN event_type = 'error' THEN 'failed' ELSE 'processing' END AS status,
    {corpus.SQL_ISO.format(f"CASE WHEN event_type = 'error' THEN TIMESTAMP '{NOW}' + INTERVAL 1 DAY ELSE ts END")} AS available_at, CASE WHEN event_type = 'error' THEN 256 END AS code_length FROM events""")
def outbox_settled(spark, sf_dir):
    now = F.lit(NOW).cast("timestamp_ntz")
    e = corpus.read(spark, sf_dir, "events")
    jobs = e.select(F.col("event_id").alias("job_id"), "event_type", F.lit("processing").alias("status"), F.col("ts").cast("timestamp_ntz").alias("available_at"), now.alias("locked_at"), F.lit(None).cast("string").alias("failure_code"))
    failed = state.retried(jobs.where("event_type = 'error'"), now, 10**9, "x" * 300)
    rows = state.completed(jobs.where("event_type <> 'error'"), jobs.where("event_type = 'purchase'"), now).unionByName(failed, allowMissingColumns=True)
    return rows.select(F.col("job_id").alias("event_id"), "status", iso("available_at").alias("available_at"), F.length("failure_code").alias("code_length"))
