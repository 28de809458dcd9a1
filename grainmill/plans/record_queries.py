"""Whole records, import plans and totals of the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions import text as t
from grainmill.operators import manifest, records, retrieval
from grainmill.plans.catalogue import query
from grainmill.sources import corpus, entities

VIEWER = 7
ELIGIBLE = "repository_license_eligible_pending_file_checks"
FOUND = ", ".join(f"'{x}'" for x in entities.LICENSES)
DIGIT = "CAST(('0x' || substr(sha256({}), 1, 1)) AS INT)"
READ = corpus.SQL_READABLE.format(c="h.", viewer=VIEWER)

ENTITIES = f"""{corpus.SQL},
licenses AS (SELECT 'lic-' || lower(spdx_id) AS license_id, spdx_id FROM (SELECT unnest([{FOUND}]) AS spdx_id)),
repositories AS (SELECT 'src_' || substr(sha256(source), 1, 32) AS source_repository_id, 'owner/' || source AS repository, CASE WHEN {DIGIT.format('source')} < 12 THEN 'github' ELSE 'bundled' END AS provider,
  'https://host.example/' || source AS repository_source_url, {DIGIT.format('source')} % 2 = 0 AS trusted FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
provenance AS (SELECT CAST(doc_id AS VARCHAR) AS query_id, 'src_' || substr(sha256(source), 1, 32) AS source_repository_id,
  CASE WHEN length(text) % 7 <> 0 THEN 'lic-' || lower(([{FOUND}])[{DIGIT.format('source')} % {len(entities.LICENSES)} + 1]) END AS license_id, 'docs/' || doc_id || '.md' AS source_path, substr(sha256(text), 1, 40) AS commit_sha,
  CASE WHEN length(text) % 9 = 0 THEN '' ELSE 'author-' || source END AS original_author, 'https://host.example/' || source || '/blob/' || substr(sha256(text), 1, 40) AS provenance_source_url,
  CASE WHEN lang = 'de' THEN 'Notice of ' || source END AS required_notice FROM documents WHERE source IS NOT NULL),
numbered AS (SELECT *, unnest(CASE WHEN length(text) % 4 = 0 THEN [1, 2] ELSE [1] END) AS version_number, split_part(text, chr(10), 1) AS line, trim(substr(split_part(text, chr(10), 1), 1, 180)) AS own_title FROM documents),
versions AS (SELECT doc_id || '-v' || version_number AS version_id, version_number, CASE WHEN version_number = 2 THEN 'Edited: ' || own_title ELSE own_title END AS title, text AS kql,
  substr(text, length(line) + 2) AS description, string_split(text, chr(10))[-1] AS explanation,
  CASE lang WHEN 'en' THEN 'sentinel' WHEN 'fr' THEN 'defender-xdr' WHEN 'de' THEN 'azure-data-explorer' WHEN 'es' THEN 'azure-resource-graph' END AS dialect,
  list_sort(list_distinct(regexp_extract_all(own_title, '[a-z]{{6,}}'))) AS tables, CASE WHEN length(text) % 11 = 0 THEN [] ELSE [coalesce(lang, 'none')] END AS assumptions,
  length(text) % 6 = 0 AS ai_generated, CASE WHEN length(text) % 6 = 0 THEN 'local' END AS generation_model, sha256(text) AS content_hash, doc_id % 150 AS created_by_user_id FROM numbered),
heads AS (SELECT doc_id, query_id, owner_id, visibility, moderation_status, deleted, star_count, doc_id || CASE WHEN length(kql) % 4 = 0 THEN '-v2' ELSE '-v1' END AS current_version_id, updated_at AS created_at,
  CASE WHEN length(kql) % 4 = 0 THEN updated_at + INTERVAL 1 DAY ELSE updated_at END AS updated_at, CASE WHEN visibility = 'public' THEN updated_at END AS published_at FROM corpus),
joined AS (SELECT h.*, v.* EXCLUDE (version_id), p.* EXCLUDE (query_id, source_repository_id, license_id), r.*, l.spdx_id AS license_spdx, EXISTS (SELECT 1 FROM star_rows s WHERE s.doc_id = h.doc_id AND s.user_id = {VIEWER}) AS starred_by_viewer
  FROM heads h JOIN versions v ON v.version_id = h.current_version_id LEFT JOIN provenance p ON p.query_id = h.query_id LEFT JOIN repositories r ON r.source_repository_id = p.source_repository_id
  LEFT JOIN licenses l ON l.license_id = p.license_id WHERE {READ})"""
WHOLE = " AND ".join(f"coalesce({c} <> '', false)" for c in records.PARTS)
HEAD = ["query_id", "owner_id", "visibility", "moderation_status", "current_version_id", "star_count", "starred_by_viewer"]
VERSION = ["version_number", "title", "kql", "description", "explanation", "dialect", "ai_generated", "generation_model", "content_hash", "created_by_user_id"]


def _parts(spark, sf_dir):
    e = entities
    return e.heads(spark, sf_dir), e.versions(spark, sf_dir), e.provenance(spark, sf_dir), e.repositories(spark, sf_dir), e.licenses(spark)


def _records(spark, sf_dir):
    return records.nested(records.detail_rows(*_parts(spark, sf_dir), corpus.stars(spark, sf_dir), VIEWER))


@query(f"""WITH {ENTITIES} SELECT {", ".join(HEAD + VERSION)}, current_version_id AS version_id, array_to_string(tables, ' ') AS tables, array_to_string(assumptions, ' ') AS assumptions, repository AS source_repository,
    repository_source_url AS source_repository_url, {", ".join(f"{corpus.SQL_ISO.format(a)} AS {b}" for a, b in (("created_at", "created_at"), ("updated_at", "updated_at"), ("published_at", "published_at")))},
    {", ".join(f"CASE WHEN {WHOLE} THEN {v} END AS {k}" for k, v in {"from_name": "repository", "from_url": "provenance_source_url", "from_provider": "provider", "from_license": "license_spdx", "from_trusted": "trusted",
      "from_id": "source_repository_id", "from_path": "source_path", "from_commit": "commit_sha", "from_author": "original_author", "from_notice": "coalesce(required_notice, '')"}.items())} FROM joined""")
def query_records(spark, sf_dir):
    rows = records.flattened(_records(spark, sf_dir))
    p = {"from_name": "source_name", "from_url": "source_url", "from_provider": "provider", "from_license": "license_spdx", "from_trusted": "trusted", "from_id": "source_repository_id", "from_path": "source_path",
         "from_commit": "commit_sha", "from_author": "original_author", "from_notice": "required_notice"}
    rows = rows.withColumns({"tables": F.array_join("tables", " "), "assumptions": F.array_join("assumptions", " ")})
    return rows.select(*(c for c in rows.columns if c != "provenance"), *(F.col(f"provenance.{v}").alias(k) for k, v in p.items()))


@query(f"""WITH {ENTITIES} SELECT (SELECT count(*) FROM heads) AS queries, (SELECT count(*) FROM versions) AS versions, (SELECT count(*) FROM repositories) AS sources, (SELECT count(*) FROM repositories WHERE provider = 'github') AS github_sources,
    (SELECT count(*) FROM provenance) AS provenance, (SELECT count(*) FROM corpus) AS indexed, (SELECT count(*) FROM heads h JOIN versions v ON v.version_id = h.current_version_id) AS jobs""")
def corpus_totals(spark, sf_dir):
    heads, versions, provenance, repositories, _ = _parts(spark, sf_dir)
    index = retrieval.index_documents(corpus.documents(spark, sf_dir))
    jobs = heads.join(versions.select(F.col("version_id").alias("current_version_id")), "current_version_id")
    return records.totals(heads, versions, repositories, provenance, index, jobs)


# ---- import plans


MANIFEST = """rows AS (SELECT page_id, url, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '[^a-z0-9]+', '-', 'g') AS owner, length(url) AS n, regexp_extract(url, '^[a-z]+://[^/?#]+/[^/?#]*/([^?#]*)', 1) AS rest,
  regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]*)', 1) AS name FROM pages),
branched AS (SELECT *, CASE WHEN length(owner) % 2 = 0 THEN 'release/v2' ELSE 'main' END AS branch FROM rows),
listed AS (SELECT page_id, CASE WHEN n % 3 = 0 THEN upper(owner) ELSE owner END || '/' || name AS repository, branch, CASE WHEN n % 37 = 0 THEN 'ISC' WHEN length(owner) % 5 = 0 THEN 'GPL-3.0' ELSE 'MIT' END AS license_spdx,
  CASE WHEN n % 17 = 0 THEN 'http' ELSE 'https' END AS scheme, CASE WHEN n % 7 = 0 THEN 'tree' ELSE 'blob' END AS marker, CASE WHEN n % 13 = 0 THEN 'dev' ELSE branch END AS used, owner, name,
  CASE WHEN n % 19 = 0 THEN '' WHEN n % 5 = 0 THEN 'a%20b%C3%A9+/' || rest ELSE rest END AS rest, n % 4 <> 0 AS fits FROM branched),
parsed AS (SELECT *, list_aggregate(list_filter(string_split(rest, '/'), lambda x: x <> ''), 'string_agg', '/') AS parts FROM listed WHERE fits),
judged AS (SELECT *, lower(repository) AS key, CASE WHEN scheme = 'http' THEN 'unsupported-url' WHEN marker = 'tree' THEN 'repository' WHEN used <> branch THEN 'branch' WHEN coalesce(parts, '') = '' THEN 'no-path' END AS problem FROM parsed)"""


def _manifest(spark, sf_dir):
    """A manifest made of the pages' own addresses."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    name, rest = F.regexp_extract("url", "^[a-z]+://[^/?#]+/([^/?#]*)", 1), F.regexp_extract("url", "^[a-z]+://[^/?#]+/[^/?#]*/([^?#]*)", 1)
    rows = corpus.read(spark, sf_dir, "pages").select("page_id", F.regexp_replace(host, "[^a-z0-9]+", "-").alias("owner"), name.alias("name"), rest.alias("rest"), F.length("url").alias("n"))
    rows = rows.withColumn("branch", F.when(F.length("owner") % 2 == 0, "release/v2").otherwise("main"))
    own = F.concat(F.when(F.col("n") % 3 == 0, F.upper("owner")).otherwise(F.col("owner")), F.lit("/"), "name")
    tail = F.when(F.col("n") % 19 == 0, "").when(F.col("n") % 5 == 0, F.concat(F.lit("a%20b%C3%A9+/"), "rest")).otherwise(F.col("rest"))
    url = F.concat(
        F.when(F.col("n") % 17 == 0, "http").otherwise("https"), F.lit("://github.com/"), "owner", F.lit("/"), "name", F.when(F.col("n") % 7 == 0, "/tree/").otherwise("/blob/"),
        F.when(F.col("n") % 13 == 0, "dev").otherwise(F.col("branch")), F.lit("/"), tail, F.lit("?plain=1"),
    )
    return rows.select(
        url.alias("upstream_source_url"), own.alias("upstream_repository"), F.col("branch").alias("repository_default_branch"),
        F.when(F.col("n") % 37 == 0, "ISC").when(F.length("owner") % 5 == 0, "GPL-3.0").otherwise("MIT").alias("repository_license_spdx"),
        F.when(F.col("n") % 4 != 0, ELIGIBLE).otherwise("repository_license_missing").alias("ingestion_license_status"),
    )


def _sources(spark, sf_dir):
    return manifest.sources(manifest.eligible(_manifest(spark, sf_dir), ELIGIBLE))


@query(f"WITH {MANIFEST} SELECT key, repository, branch AS default_branch, license_spdx, CASE WHEN problem IS NULL THEN url_decode(replace(parts, '+', '%2B')) END AS path, problem FROM judged")
def manifest_sources(spark, sf_dir):
    return _sources(spark, sf_dir)


@query(f"""WITH {MANIFEST} SELECT key, min(repository) AS repository, min(branch) AS default_branch, min(license_spdx) AS license_spdx, count(DISTINCT parts) AS paths,
    CASE WHEN count(DISTINCT branch) > 1 OR count(DISTINCT license_spdx) > 1 THEN 'inconsistent' WHEN min(license_spdx) NOT IN ({", ".join(f"'{x}'" for x in t.APPROVED_LICENSES)}) THEN 'license' END AS problem
    FROM judged WHERE problem IS NULL GROUP BY key""")
def manifest_repositories(spark, sf_dir):
    return manifest.repositories(_sources(spark, sf_dir).where("problem is null"))
