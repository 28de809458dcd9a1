"""Text rules over an augmented copy of the documents' texts.

The raw texts have no tokens, code or CR line ends; so each text gets a fixed ending
by its id, the same in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions import text as t
from grainmill.operators import ingest
from grainmill.plans.catalogue import query
from grainmill.sources import corpus
from grainmill.sources.corpus import SQL

ENDINGS = {
    0: " ghp_{h}", 1: " eyJ{h}.{h}.{h}", 2: " Bearer {h}", 3: " password = '{h}'",
    4: "\r\n\r\n \t\n\n\nbrute force phishing T1059.001 and T1566, EventId == 4625  \n\n",
    5: " https://x.example/a 123e4567-e89b-12d3-a456-426614174000", 6: " DefaultEndpointsProtocol=https;AccountName=a;AccountKey={h}",
}
LICENSES = [*t.APPROVED_LICENSES, "GPL-3.0", "CC-BY-NC-4.0", ""]


def augmented(spark, sf_dir):
    d = corpus.documents(spark, sf_dir)
    h = F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 24)
    end = F.coalesce(*(F.when(F.col("doc_id") % 7 == k, F.replace(F.lit(v), F.lit("{h}"), h)) for k, v in ENDINGS.items()))
    return d.withColumn("body", F.concat("kql", end))


def _literal(v: str) -> str:
    out = v.replace("'", "''")
    for c in "\r\n\t":
        out = out.replace(c, f"' || chr({ord(c)}) || '")
    return f"'{out}'"


AUG = f"""{SQL}, aug AS (SELECT *, kql || CASE doc_id % 7 {" ".join(f"WHEN {k} THEN replace({_literal(v)}, '{{h}}', substr(sha256(CAST(doc_id AS VARCHAR)), 1, 24))" for k, v in ENDINGS.items())} END AS body FROM corpus)"""


@query(f"WITH {AUG} SELECT query_id, sha256({t.sql_normalize_body('body')}) AS body_hash, length({t.sql_normalize_body('body')}) AS body_length FROM aug")
def normalize_text(spark, sf_dir):
    body = t.normalize_body(F.col("body"))
    return augmented(spark, sf_dir).select("query_id", F.sha2(body, 256).alias("body_hash"), F.length(body).cast("long").alias("body_length"))


@query(f"WITH {SQL} SELECT query_id, 'imported_query_' || substr(sha256(lower(repository) || ':docs/' || query_id || ':' || CAST(doc_id % 3 AS VARCHAR)), 1, 32) AS stable_id FROM corpus")
def stable_id(spark, sf_dir):
    identity = t.source_identity(F.col("repository"), F.concat(F.lit("docs/"), "query_id"), F.col("doc_id") % 3)
    return corpus.documents(spark, sf_dir).select("query_id", t.stable_id("imported_query", identity).alias("stable_id"))


@query(f"WITH {AUG} SELECT query_id, sha256({t.sql_normalize_body('body')} || chr(0) || dialect || chr(0) || lower(repository) || ':docs/' || query_id || ':0') AS dedupe_key FROM aug")
def dedupe_key(spark, sf_dir):
    identity = t.source_identity(F.col("repository"), F.concat(F.lit("docs/"), "query_id"), F.lit(0))
    return augmented(spark, sf_dir).select("query_id", t.dedupe_key(F.col("body"), F.col("dialect"), identity).alias("dedupe_key"))


@query(f"WITH {SQL} SELECT query_id, sha256(CAST(to_json({{'title': title, 'kql': kql, 'dialect': dialect, 'tables': tables, 'tags': tags}}) AS VARCHAR)) AS content_hash FROM corpus")
def content_hash(spark, sf_dir):
    rows = corpus.documents(spark, sf_dir)
    return rows.select("query_id", t.content_hash(title=F.col("title"), kql=F.col("kql"), dialect=F.col("dialect"), tables=F.col("tables"), tags=F.col("tags")).alias("content_hash"))


@query(f"WITH {AUG} SELECT query_id, {t.sql_rules('body', t.SECRET_RULES)} AS warnings FROM aug")
def secret_warnings(spark, sf_dir):
    return augmented(spark, sf_dir).select("query_id", F.array_join(t.matched_rules(F.col("body"), t.SECRET_RULES), "|").alias("warnings"))


@query(f"WITH {AUG} SELECT query_id, {t.sql_rules('body', t.TAG_RULES)} AS findings FROM aug")
def pii_tags(spark, sf_dir):
    return augmented(spark, sf_dir).select("query_id", F.array_join(t.matched_rules(F.col("body"), t.TAG_RULES), "|").alias("findings"))


@query(f"WITH {AUG} SELECT query_id, {t.sql_rules('body', t.TOPIC_RULES, '(?i)')} AS topics FROM aug")
def topic_tags(spark, sf_dir):
    return augmented(spark, sf_dir).select("query_id", F.array_join(t.matched_rules(F.col("body"), t.TOPIC_RULES, "(?i)"), "|").alias("topics"))


@query(f"""WITH {AUG} SELECT query_id, lower(array_to_string(regexp_extract_all(body, '\\bT\\d{{4}}(?:\\.\\d{{3}})?\\b'), ' ')) AS techniques,
    array_to_string(['event-id-' || x for x in regexp_extract_all(body, '(?i)\\bEventId\\)?\\s*(?:==|=~|in)\\s*\\(?\\s*[''"]?(\\d{{3,5}})\\b', 1)], ' ') AS event_ids FROM aug""")
def technique_tags(spark, sf_dir):
    return augmented(spark, sf_dir).select("query_id", F.array_join(ingest.technique_tags(F.col("body")), " ").alias("techniques"), F.array_join(ingest.event_tags(F.col("body")), " ").alias("event_ids"))


@query(f"""WITH {SQL}, p AS (SELECT page_id, regexp_extract(url, '[^/]*$') AS name FROM pages), s AS (SELECT page_id, regexp_replace(name, '(.)\\.[^.]*\\z', '\\1') AS stem FROM p),
    w AS (SELECT page_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(stem, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[_-]+', ' ', 'g'), '[ \\t\\r\\n\\f]+', ' ', 'g')), 1, 180) AS title FROM s)
    SELECT page_id, CASE WHEN title = '' THEN 'Untitled query' ELSE title END AS title FROM w""")
def title_from_path(spark, sf_dir):
    return corpus.read(spark, sf_dir, "pages").select("page_id", t.title_from_path(F.col("url")).alias("title"))


TITLES = ["The KQL queries", "Microsoft Sentinel 5", "Defender XDR and Intune device query", "3) Examples", "Failed logons by user", "Update the query"]
GENERIC_SQL = "trim(regexp_replace(title, '[ \\t\\r\\n\\f]+', ' ', 'g'))"
for _p in t.GENERIC_STEPS:
    GENERIC_SQL = f"regexp_replace({GENERIC_SQL}, '{_p}', '')"


@query(f"""WITH {SQL}, x AS (SELECT query_id, CASE doc_id % 10 {" ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(TITLES))} ELSE title END AS title FROM corpus), y AS (SELECT query_id, {GENERIC_SQL} AS s FROM x)
    SELECT query_id, s = '' OR regexp_matches(s, '(?i)^(?:update\\s+the(?:\\s+query)?|follow[-\\s]?up\\s+pivots?(?:\\s*\\(\\s*recommended\\s*\\))?)$')
      OR len([z for z in string_split_regex(s, '{t.GENERIC_SPLIT}') if z <> '' AND NOT regexp_matches(z, '(?i)^{t.GENERIC_PART}$')]) = 0 AS generic FROM y""")
def generic_title(spark, sf_dir):
    title = F.coalesce(*(F.when(F.col("doc_id") % 10 == i, F.lit(v)) for i, v in enumerate(TITLES)), F.col("title"))
    return corpus.documents(spark, sf_dir).select("query_id", t.is_generic_title(title).alias("generic"))


@query(f"""WITH {SQL}, l AS (SELECT query_id, CASE doc_id % 10 {" ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(LICENSES))} END AS spdx FROM corpus)
    SELECT query_id, spdx IN ({", ".join(f"'{x}'" for x in t.APPROVED_LICENSES)}) AS accepted FROM l""")
def license_gate(spark, sf_dir):
    return _licensed(spark, sf_dir).select("query_id", F.col("spdx").isin(t.APPROVED_LICENSES).alias("accepted"))


def _licensed(spark, sf_dir):
    spdx = F.coalesce(*(F.when(F.col("doc_id") % 10 == i, F.lit(v)) for i, v in enumerate(LICENSES)))
    return corpus.documents(spark, sf_dir).withColumn("spdx", spdx)


@query(f"""WITH {SQL}, l AS (SELECT query_id, CASE doc_id % 10 {" ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(LICENSES))} END AS spdx FROM corpus)
    SELECT query_id, CASE WHEN spdx IN ({", ".join(f"'{x}'" for x in t.APPROVED_LICENSES)}) THEN 'accepted' WHEN spdx = '' THEN 'LICENSE_MISSING' ELSE 'LICENSE_NOT_ALLOWED' END AS reason FROM l""")
def license_reason(spark, sf_dir):
    return _licensed(spark, sf_dir).select("query_id", ingest.license_reason(F.col("spdx")).alias("reason"))


@query(f"""WITH {SQL} SELECT query_id, sha256(concat_ws(chr(10) || chr(10), nullif(title, ''), 'Dialect: ' || dialect, CASE WHEN len(tables) > 0 THEN 'Tables: ' || array_to_string(tables, ', ') END,
    CASE WHEN len(operators) > 0 THEN 'Operators: ' || array_to_string(operators, ', ') END, CASE WHEN len(tags) > 0 THEN 'Tags: ' || array_to_string(tags, ', ') END, nullif(description, ''), nullif(kql, ''))) AS embedding_hash FROM corpus""")
def embedding_text(spark, sf_dir):
    return corpus.documents(spark, sf_dir).select("query_id", F.sha2(t.embedding_text(), 256).alias("embedding_hash"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a,b' WHEN 1 THEN '' WHEN 2 THEN 'true' ELSE '' END AS members FROM events""")
def json_string_members(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, ['["a", 1, null, "b"]', '{"x": 1}', '["true", true]', "[broken"])), (F.col("event_id") % 4 + 1).cast("int"))
    return corpus.read(spark, sf_dir, "events").select("event_id", F.array_join(t.strip_strings(raw), ",").alias("members"))


@query(f"""SELECT event_id, CASE event_type WHEN 'view' THEN 'sentinel' WHEN 'signup' THEN 'azure-data-explorer' WHEN 'purchase' THEN 'defender-xdr' WHEN 'click' THEN 'azure-resource-graph' END AS dialect FROM events""")
def dialect_alias(spark, sf_dir):
    name = F.element_at(F.create_map(*map(F.lit, ["view", " Microsoft-Sentinel", "signup", "Kusto", "purchase", "advanced-hunting", "click", "ARG", "error", "unknown"])), F.col("event_type"))
    return corpus.read(spark, sf_dir, "events").select("event_id", t.dialect_of(name).alias("dialect"))
