"""Gates, block extraction, query-text rules and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions import text as t
from grainmill.operators import ingest, parsing
from grainmill.plans.catalogue import query
from grainmill.plans.text_queries import LICENSES
from grainmill.sources import corpus
from grainmill.sources.corpus import SQL

EXT = ["kql", "md", "yaml", "txt", "KUSTO", "mdx"]


def _files(spark, sf_dir):
    d = corpus.documents(spark, sf_dir)
    path = F.concat(F.when(F.col("doc_id") % 11 == 0, "../").otherwise("docs/"), F.col("query_id"), F.lit("."), F.element_at(F.array(*map(F.lit, EXT)), (F.col("doc_id") % 6 + 1).cast("int")))
    spdx = F.element_at(F.array(*map(F.lit, LICENSES)), (F.col("doc_id") % len(LICENSES) + 1).cast("int"))
    head = F.when(F.col("doc_id") % 13 == 0, "// SPDX-License-Identifier: MIT\n").otherwise("")
    return d.select("query_id", F.col("repository"), spdx.alias("spdx"), path.alias("path"), F.concat(head, F.col("kql")).alias("content"))


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


GATED = f"""files AS (SELECT query_id, doc_id, repository, ({_list(LICENSES)})[CAST(doc_id % {len(LICENSES)} AS INT) + 1] AS spdx, doc_id % 11 = 0 AS unsafe, ({_list(EXT)})[CAST(doc_id % 6 AS INT) + 1] AS ext, doc_id % 13 = 0 AS declared, kql FROM corpus),
gated AS (SELECT *, CASE WHEN spdx = '' THEN 'LICENSE_MISSING' WHEN spdx NOT IN ({", ".join(f"'{x}'" for x in t.APPROVED_LICENSES)}) THEN 'LICENSE_NOT_ALLOWED' WHEN unsafe THEN 'UNSAFE_PATH' WHEN ext = 'txt' THEN 'UNSUPPORTED_FILE'
  WHEN strlen(kql) + CASE WHEN declared THEN 32 ELSE 0 END > 1000000 THEN 'FILE_TOO_LARGE' WHEN trim(kql) = '' AND NOT declared THEN 'EMPTY_FILE' WHEN declared AND spdx <> 'MIT' THEN 'LICENSE_METADATA_MISMATCH' END AS skip_reason FROM files)"""


@query(f"WITH {SQL}, {GATED} SELECT query_id, coalesce(skip_reason, 'accepted') AS reason FROM gated")
def file_gate(spark, sf_dir):
    return ingest.gated_files(_files(spark, sf_dir)).select("query_id", F.coalesce("skip_reason", F.lit("accepted")).alias("reason"))


@query(f"WITH {SQL}, {GATED} SELECT coalesce(skip_reason, 'accepted') AS code, count(*) AS n FROM gated GROUP BY 1")
def skip_histogram(spark, sf_dir):
    return ingest.skip_histogram(ingest.gated_files(_files(spark, sf_dir)))


@query(f"""WITH {SQL}, {GATED}, r AS (SELECT coalesce(skip_reason, 'accepted') AS code, query_id, row_number() OVER (PARTITION BY coalesce(skip_reason, 'accepted') ORDER BY query_id) AS k FROM gated)
    SELECT code, count(*) AS n, string_agg(CASE WHEN k <= 10 THEN query_id END, ',' ORDER BY k) AS samples FROM r GROUP BY code""")
def issue_samples(spark, sf_dir):
    rows = ingest.gated_files(_files(spark, sf_dir)).select(F.coalesce("skip_reason", F.lit("accepted")).alias("code"), "query_id")
    return ingest.issue_samples(rows)


URL = """u AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+/([^?#]*)', 1) AS full_path FROM (
  SELECT page_id, CASE WHEN page_id % 5 = 0 THEN regexp_replace(url, '([?#].*)?$', '') || '/a%20b%C3%A9' ELSE url END AS url FROM pages)),
v AS (SELECT page_id, host, split_part(full_path, '/', 1) AS branch, url_decode(regexp_extract(full_path, '^[^/]*/(.*)$', 1)) AS path FROM u)"""


def _urls(spark, sf_dir):
    url = F.when(F.col("page_id") % 5 == 0, F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/a%20b%C3%A9"))).otherwise(F.col("url"))
    parts = ingest.url_parts(url)
    return corpus.read(spark, sf_dir, "pages").select("page_id", *(c.alias(k) for k, c in parts.items()))


@query(f"WITH {URL} SELECT * FROM v")
def source_path_parse(spark, sf_dir):
    return _urls(spark, sf_dir)


@query(f"WITH {URL} SELECT host AS repository, count(DISTINCT path) AS paths, min(path) AS first_path, count(DISTINCT branch) AS branches, count(DISTINCT branch) <= 1 AS consistent FROM v GROUP BY host")
def manifest_group(spark, sf_dir):
    return ingest.manifest_groups(_urls(spark, sf_dir).withColumnRenamed("host", "repository"))


RULES = [("en", "sentinel"), ("fr", "defender-xdr"), ("en/1", "azure-data-explorer"), ("de", "azure-resource-graph"), ("en/10", "intune-device-query")]


@query(f"""WITH {URL}, p AS (SELECT page_id, branch || '/' || substr(path, 1, 1) || '/' || path AS path FROM v), r AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in RULES)}) t(prefix, dialect))
    SELECT page_id, p.path AS path, arg_max(dialect, length(prefix)) AS dialect FROM p LEFT JOIN r ON p.path = prefix OR starts_with(p.path, prefix || '/') GROUP BY page_id, p.path""")
def prefix_dialect_rule(spark, sf_dir):
    path = F.concat(F.col("branch"), F.lit("/"), F.substring("path", 1, 1), F.lit("/"), F.col("path"))
    rules = spark.createDataFrame(RULES, "prefix string, dialect string")
    return ingest.longest_prefix(_urls(spark, sf_dir).select("page_id", path.alias("path")), rules, "page_id")


MARKDOWN = "# IP\n\n```kql\nSigninLogs\n| where IPAddress == \"{q}\"\n| take 10\n```\n\n## Subnet\n```sql\nselect 1\n```\n# IP\n~~~Kusto\nlet a = DeviceEvents;\na | union AuditLogs, SecurityEvent | summarize count() by DeviceId\n~~~\n```json\n{{}}\n```\n### Hunting query\n```\nHeartbeat | order by TimeGenerated\n```\n"
YAML = "id: {q}\nname: \"Rule {q}\"\ndescription: Finds things\nquery: |\n  SigninLogs\n  | where UserId == {q}\n---\nname: Second\nseverity: Low\nquery: Heartbeat | take 5\n"


def _texts(spark, sf_dir, template: str, ext: str):
    d = corpus.documents(spark, sf_dir)
    content = F.replace(F.lit(template.replace("{{", "{").replace("}}", "}")), F.lit("{q}"), F.col("query_id"))
    return d.select("query_id", F.concat(F.lit("docs/"), "query_id", F.lit("." + ext)).alias("path"), content.alias("content"))


@query(f"""WITH {SQL} SELECT 'docs/' || query_id || '.md' AS path, block, t.title AS title, language, replace(body, '@', query_id) AS body FROM corpus,
    (VALUES (0, 'IP', 'kql', 'SigninLogs' || chr(10) || '| where IPAddress == "@"' || chr(10) || '| take 10'), (2, 'IP 2', 'kusto', 'let a = DeviceEvents;' || chr(10) || 'a | union AuditLogs, SecurityEvent | summarize count() by DeviceId'),
      (3, 'Hunting query', '', 'Heartbeat | order by TimeGenerated')) t(block, title, language, body)""")
def markdown_blocks(spark, sf_dir):
    return parsing.markdown_blocks(_texts(spark, sf_dir, MARKDOWN, "md"), ["path"]).select("path", "block", "title", "language", "body")


@query(f"""WITH {SQL} SELECT 'docs/' || query_id || '.yaml' AS path, block, replace(t.title, '@', query_id) AS title, t.description AS description, replace(body, '@', query_id) AS body FROM corpus,
    (VALUES (0, 'Rule @', 'Finds things', 'SigninLogs' || chr(10) || '| where UserId == @'), (1, 'Second', '', 'Heartbeat | take 5')) t(block, title, description, body)""")
def yaml_rules(spark, sf_dir):
    return parsing.yaml_blocks(_texts(spark, sf_dir, YAML, "yaml"), ["path"]).select("path", "block", "title", "description", "body")


@query(f"""WITH {SQL}, p AS (SELECT DISTINCT repository, coalesce(w[1], '') || '/' || coalesce(w[2], '') || '_' || coalesce(w[3], '') || '.kql' AS path FROM (SELECT repository, regexp_extract_all(kql, '\\p{{L}}+') AS w FROM corpus))
    SELECT repository, path, CAST(row_number() OVER (PARTITION BY repository ORDER BY path COLLATE en_us, path) AS INTEGER) AS place FROM p""")
def processed_paths(spark, sf_dir):
    word = lambda i: F.coalesce(F.get(F.regexp_extract_all("kql", F.lit("\\p{L}+"), F.lit(0)), F.lit(i)), F.lit(""))
    path = F.concat(word(0), F.lit("/"), word(1), F.lit("_"), word(2), F.lit(".kql"))
    return ingest.ordered_paths(corpus.documents(spark, sf_dir).select("repository", path.alias("path")))
