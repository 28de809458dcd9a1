"""Review of the corpus: requests to take queries down, audits of versions, and what queries read."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions import text as t
from grainmill.functions.query_text import scope_summary
from grainmill.operators import audit, moderation
from grainmill.operators.feeds import iso
from grainmill.plans.catalogue import query
from grainmill.plans.record_queries import ENTITIES
from grainmill.sources import corpus, entities
from grainmill.sources.corpus import SQL

PUBLIC = corpus.SQL_PUBLIC.format(c="")
TAKEN = f"""admins AS (SELECT user_id FROM events WHERE event_type = 'signup' GROUP BY user_id HAVING count(*) >= 2),
asked AS (SELECT r.*, a.user_id IS NOT NULL AS is_admin, p.doc_id IS NOT NULL AS shown FROM report_rows r LEFT JOIN admins a USING (user_id) LEFT JOIN (SELECT doc_id FROM corpus WHERE {PUBLIC}) p USING (doc_id)),
judged AS (SELECT *, CASE WHEN NOT is_admin THEN 'ADMIN_REQUIRED' WHEN shown AND row_number() OVER (PARTITION BY doc_id, is_admin ORDER BY ts, event_id) = 1 THEN 'unpublished' ELSE 'PUBLIC_QUERY_NOT_FOUND' END AS outcome FROM asked),
done AS (SELECT doc_id, user_id AS by_, ts AS at_ FROM judged WHERE outcome = 'unpublished')"""


@query(f"""WITH {SQL}, {TAKEN} SELECT 'request' AS part, CAST(event_id AS VARCHAR) AS id, outcome AS state, user_id AS by_user, CAST(NULL AS VARCHAR) AS at FROM judged UNION ALL
    SELECT 'log', CAST(event_id AS VARCHAR), 'public', user_id, {corpus.SQL_ISO.format('ts')} FROM judged WHERE outcome = 'unpublished' UNION ALL
    SELECT 'head', query_id, CASE WHEN d.doc_id IS NULL THEN moderation_status ELSE 'unpublished' END, NULL, {corpus.SQL_ISO.format('coalesce(at_, updated_at)')} FROM corpus LEFT JOIN done d USING (doc_id) UNION ALL
    SELECT 'report', CAST(event_id AS VARCHAR), CASE WHEN d.doc_id IS NOT NULL AND event_id % 4 <> 0 THEN 'actioned' WHEN event_id % 4 = 0 THEN 'dismissed' ELSE 'open' END, CASE WHEN event_id % 4 <> 0 THEN by_ END,
      {corpus.SQL_ISO.format('CASE WHEN event_id % 4 <> 0 THEN at_ END')} FROM report_rows LEFT JOIN done d USING (doc_id)""")
def taken_down(spark, sf_dir):
    rows = corpus.reports(spark, sf_dir)
    requests = rows.select(F.col("event_id").alias("request_id"), "doc_id", F.col("user_id").alias("admin_id"), F.lit(" spam ").alias("reason"), F.col("ts").alias("at"))
    reports = rows.select("event_id", "doc_id", F.when(F.col("event_id") % 4 == 0, "dismissed").otherwise("open").alias("status"))
    users = corpus.read(spark, sf_dir, "events").where("event_type = 'signup'").groupBy("user_id").agg(F.when(F.count(F.lit(1)) >= 2, "admin").otherwise("user").alias("role"))
    heads = corpus.labelled(corpus.documents(spark, sf_dir), spark, sf_dir).select("doc_id", "query_id", "visibility", "moderation_status", "deleted", "updated_at")
    found = moderation.take_down(requests, users, heads, reports)
    part = lambda df, name, key, state, by, at: df.select(F.lit(name).alias("part"), F.col(key).cast("string").alias("id"), F.col(state).alias("state"), by.cast("long").alias("by_user"), at.alias("at"))
    none = F.lit(None).cast("string")
    out = part(found.outcomes, "request", "request_id", "outcome", F.col("admin_id"), none)
    for df in (
        part(found.log, "log", "request_id", "previous_visibility", F.col("admin_id"), iso("at")), part(found.heads, "head", "query_id", "moderation_status", none, iso("updated_at")),
        part(found.reports, "report", "event_id", "status", F.col("reviewed_by"), iso("reviewed_at")),
    ):
        out = out.unionByName(df)
    return out


# ---- audits


def _audited(spark, sf_dir):
    """Heads some of which point at no version, at one that is not there, or at another query's."""
    size = corpus.read(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("size"))
    points = F.when(F.col("size") % 31 == 0, None).when(F.col("size") % 29 == 0, F.concat("query_id", F.lit("-v9"))).when(F.col("size") % 27 == 0, "0-v1").otherwise(F.col("current_version_id"))
    heads = entities.heads(spark, sf_dir).join(size, "doc_id").withColumn("current_version_id", points)
    versions = entities.versions(spark, sf_dir).withColumns({"tables": t.strip_strings(F.col("tables_json")), "tags": t.strip_strings(F.col("assumptions_json"))})
    return heads, versions


POINTED = f"""{ENTITIES}, pointed AS (SELECT h.query_id, CASE WHEN length(c.kql) % 31 = 0 THEN NULL WHEN length(c.kql) % 29 = 0 THEN h.query_id || '-v9' WHEN length(c.kql) % 27 = 0 THEN '0-v1' ELSE current_version_id END AS pointed
  FROM heads h JOIN corpus c USING (doc_id) WHERE NOT h.deleted),
stated AS (SELECT p.query_id, CASE WHEN pointed IS NULL THEN 'missing' WHEN v.version_id IS NULL THEN 'dangling' WHEN split_part(v.version_id, '-', 1) <> p.query_id THEN 'foreign' ELSE 'valid' END AS state, title
  FROM pointed p LEFT JOIN versions v ON v.version_id = p.pointed),
titled AS (SELECT s.query_id, min(s.query_id) OVER (PARTITION BY lower(r.repository), lower(trim(title))) AS first_id FROM stated s JOIN provenance USING (query_id) JOIN repositories r USING (source_repository_id)
  WHERE state = 'valid' AND trim(title) <> '')"""


@query(f"""WITH {POINTED} SELECT query_id, 'current-version' AS code, state AS detail FROM stated WHERE state <> 'valid' UNION ALL
    SELECT query_id, 'duplicate-source-title', first_id FROM titled WHERE query_id <> first_id""")
def audit_sources(spark, sf_dir):
    """The findings of an audit that have a detail: versions, and titles that repeat in a source."""
    return audit.audited(*_audited(spark, sf_dir), entities.provenance(spark, sf_dir), entities.repositories(spark, sf_dir)).where("detail is not null")


@query()
def audit_corpus(spark, sf_dir):
    """All findings of an audit; the codes that need the lexer have their SQL in ``audit_texts``."""
    return audit.audited(*_audited(spark, sf_dir), entities.provenance(spark, sf_dir), entities.repositories(spark, sf_dir))


# ---- what a query reads


#: Bodies by the text's length; {w} is a word of the document, {q} its first line in double quotes.
READS = [
    "search {q}", "find in ({w}, Other) where x == 1", "union isfuzzy=true kind=outer * | take 5", "let name = 'x'; table(name) | take 1", "print 1 // search everything", "search kind=case_sensitive in ({w}) {q}",
    "let found = find where y == 1; found", "print x = {q} | where 'union *' != x",
]
_UNSCOPED = r"(?im)(?:^|[;|])\s*(?:let\s+[A-Za-z_][A-Za-z0-9_]*\s*=\s*)?(?:search|find)\b"
_CASES = " ".join(f"WHEN {i} THEN " + " || ".join({"{w}": "w", "{q}": "line"}.get(p, "'" + p.replace("'", "''") + "'") for p in x.replace("{w}", "\0{w}\0").replace("{q}", "\0{q}\0").split("\0") if p) for i, x in enumerate(READS))


@query(f"""WITH b AS (SELECT doc_id, text, length(text) AS n, coalesce(nullif(regexp_extract(text, '[A-Za-z]{{4,}}'), ''), 'Events') AS w FROM documents),
    m AS (SELECT *, CASE n % {len(READS)} {_CASES.replace('|| line', "|| '  '").replace("THEN line", "THEN '  '")} END AS code FROM b),
    c AS (SELECT *, regexp_replace(replace(code, '''union *''', '         '), '(//.*)|(''x'')', '', 'g') AS plain FROM m)
    SELECT doc_id, CASE WHEN n % 5 = 0 THEN w || ', Other' WHEN regexp_matches(plain, '{_UNSCOPED}') AND NOT regexp_matches(plain, '\\bin\\s*\\(') THEN 'All tables in the current scope'
      WHEN n % 3 = 0 AND NOT regexp_matches(plain, '(search|find)\\b.*\\bin\\s*\\(') THEN 'All tables in the current scope'
      WHEN regexp_matches(plain, 'union\\b(\\s+[a-z]+=[a-z]+)*\\s+\\*') THEN 'All tables in the current scope' WHEN regexp_matches(plain, 'table\\(') THEN 'Table name selected at runtime' ELSE 'No physical table referenced' END AS reads FROM c""")
def scope_summaries(spark, sf_dir):
    n, word = F.length("text"), F.coalesce(F.nullif(F.regexp_extract("text", "[A-Za-z]{4,}", 0), F.lit("")), F.lit("Events"))
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.substring_index("text", "\n", 1), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    bodies = [F.replace(F.replace(F.lit(x), F.lit("{w}"), word), F.lit("{q}"), quoted) for x in READS]
    body = F.element_at(F.array(*bodies), (n % len(READS) + 1).cast("int"))
    tables = F.when(n % 5 == 0, F.array(word, F.lit("Other"))).otherwise(F.array().cast("array<string>"))
    operators = F.when(n % 3 == 0, F.array(F.lit(" Search "), F.lit("take"))).otherwise(F.array(F.lit("take")))
    return corpus.spread(corpus.read(spark, sf_dir, "documents")).select("doc_id", scope_summary(body, tables, operators).alias("reads"))
