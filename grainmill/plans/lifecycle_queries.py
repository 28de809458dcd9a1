"""Authored queries, id resolution and the remaining ingest rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.operators import ingest, lifecycle, resolve
from grainmill.operators.feeds import iso
from grainmill.operators.visibility import public
from grainmill.plans.catalogue import query
from grainmill.sources import corpus
from grainmill.sources.corpus import SQL

NOW = "2024-06-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _heads(spark, sf_dir):
    published = F.when((F.col("visibility") == "public") & (F.col("doc_id") % 2 == 0), F.col("updated_at"))
    return corpus.labelled(corpus.documents(spark, sf_dir), spark, sf_dir).withColumn("published_at", published).withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))


_STRIP = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(65279))"
CONTENT_SQL = (
    "sha256(CAST(to_json({{'title': " + _STRIP.format("{title}") + ", 'kql': replace(replace(" + _STRIP.format("{body}") + ", chr(13) || chr(10), chr(10)), chr(13), chr(10)), 'description': " + _STRIP.format("description")
    + ", 'explanation': " + _STRIP.format("string_split(kql, chr(10))[-1]") + ", 'dialect': dialect, 'tables': tables, 'operators': operators, 'tags': tags, 'assumptions': [repository], 'validationWarnings': CAST([] AS VARCHAR[])}}) AS VARCHAR))"
)


def _versioned(spark, sf_dir):
    """Documents with what else a version says; their line breaks are those of another system."""
    d = corpus.documents(spark, sf_dir)
    return d.withColumns({"explanation": F.substring_index("kql", "\n", -1), "assumptions": F.array("repository"), "kql": F.replace("kql", F.lit("\n"), F.lit("\r\n"))})


@query(f"WITH {SQL} SELECT query_id, 1 AS version_number, {CONTENT_SQL.format(title='title', body='kql')} AS content_hash FROM corpus WHERE length(trim(title)) BETWEEN 1 AND 180 AND length(trim(replace(kql, chr(10), chr(13) || chr(10)))) BETWEEN 1 AND 100000")
def create_versions(spark, sf_dir):
    return lifecycle.created(_versioned(spark, sf_dir), _now()).select("query_id", "version_number", "content_hash")


@query(f"WITH {SQL} SELECT query_id, 2 AS version_number, {CONTENT_SQL.format(title="title || '!'", body='kql')} AS content_hash FROM corpus WHERE doc_id % 5 = 0 AND doc_id % 2 = 0")
def update_versions(spark, sf_dir):
    d = _versioned(spark, sf_dir)
    current = d.select("query_id", "owner_id", F.lit(1).cast("long").alias("version_number"), lifecycle.content_hash(d).alias("content_hash"))
    edits = d.where("doc_id % 5 = 0").withColumn("editor", F.when(F.col("doc_id") % 2 == 0, F.col("owner_id")).otherwise(-1))
    same = d.where("doc_id % 5 = 1").withColumns({"editor": F.col("owner_id"), "kql": F.concat(F.lit(" "), F.replace("kql", F.lit("\r\n"), F.lit("\n")))})
    edits = edits.unionByName(same)  # equal content: no version
    edits = edits.withColumn("title", F.when(F.col("doc_id") % 5 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    return lifecycle.updated(current, edits).select("query_id", "version_number", "content_hash")


@query(f"""WITH {SQL}, h AS (SELECT *, CASE WHEN visibility = 'public' AND doc_id % 2 = 0 THEN updated_at END AS published_at FROM corpus), w AS (SELECT *, CASE WHEN doc_id % 3 = 0 AND doc_id % 4 <> 0 THEN 'private' ELSE visibility END AS v FROM h)
    SELECT query_id, v AS visibility, {corpus.SQL_ISO.format(f"coalesce(published_at, CASE WHEN v = 'public' THEN TIMESTAMP '{NOW}' END)")} AS published_at FROM w""")
def visibility_changes(spark, sf_dir):
    h = _heads(spark, sf_dir)
    wishes = h.where("doc_id % 3 = 0").select("query_id", F.lit("private").alias("visibility"), F.when(F.col("doc_id") % 4 == 0, -1).otherwise(F.col("owner_id")).alias("owner_id"))
    return lifecycle.with_visibility(h, wishes, _now()).select("query_id", "visibility", iso("published_at").alias("published_at"))


@query(f"WITH {SQL} SELECT query_id, CASE WHEN doc_id % 8 = 0 THEN 'private' ELSE visibility END AS visibility, CASE WHEN doc_id % 8 = 0 THEN {corpus.SQL_ISO.format(f"TIMESTAMP '{NOW}'")} END AS deleted_at FROM corpus")
def soft_deletes(spark, sf_dir):
    h = _heads(spark, sf_dir)
    gone = h.where("doc_id % 8 = 0 or doc_id % 8 = 1").select("query_id", F.when(F.col("doc_id") % 8 == 0, F.col("owner_id")).otherwise(-1).alias("owner_id"))
    return lifecycle.soft_deleted(h, gone, _now()).select("query_id", "visibility", iso("deleted_at").alias("deleted_at"))


@query(f"""WITH {SQL}, a AS (SELECT user_id, doc_id FROM star_rows UNION SELECT 3, doc_id FROM corpus WHERE doc_id % 4 = 0 AND (visibility = 'public' AND moderation_status = 'visible' AND NOT deleted)) SELECT user_id, doc_id FROM a WHERE NOT (user_id = 7 AND doc_id % 2 = 0)""")
def star_changes(spark, sf_dir):
    h = _heads(spark, sf_dir)
    stars = corpus.stars(spark, sf_dir)
    after = lifecycle.starred(stars, h.where("doc_id % 4 = 0").select(F.lit(3).cast("long").alias("user_id"), "doc_id"), h)
    return lifecycle.unstarred(after, stars.where("user_id = 7 and doc_id % 2 = 0"))


@query(f"""WITH {SQL} SELECT 'current-version' AS rule, query_id AS id FROM corpus WHERE doc_id % 41 = 0 UNION ALL SELECT 'star-on-private', CAST(s.doc_id AS VARCHAR) FROM star_rows s JOIN corpus c ON s.doc_id = c.doc_id WHERE c.visibility <> 'public'
    UNION ALL SELECT 'version-number', query_id FROM corpus WHERE doc_id % 43 = 0""")
def invariant_violations(spark, sf_dir):
    h = _heads(spark, sf_dir)
    v = h.select("query_id", "version_id", F.lit(1).alias("version_number"))
    v = v.unionByName(h.where("doc_id % 43 = 0").select("query_id", F.concat("version_id", F.lit("b")).alias("version_id"), F.lit(1).alias("version_number")))
    heads = h.withColumn("version_id", F.when(F.col("doc_id") % 41 == 0, "none").otherwise(F.col("version_id")))
    return lifecycle.violations(heads, v, corpus.stars(spark, sf_dir))


@query(f"""WITH {SQL} SELECT repository AS path, doc_id AS block, CASE WHEN doc_id % 3 = 2 THEN 'new-' || query_id ELSE query_id END AS query_id, CASE doc_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'place' ELSE 'new' END AS how FROM corpus WHERE doc_id % 10 < 6""")
def resolve_ids(spark, sf_dir):
    d = corpus.documents(spark, sf_dir).where("doc_id % 10 < 6").select(F.col("repository").alias("path"), F.col("doc_id").alias("block"), "query_id", F.concat(F.lit("T | where a == "), "query_id").alias("body"))
    incoming = d.select("path", "block", F.concat(F.lit("new-"), "query_id").alias("new_id"), F.when(F.col("block") % 3 == 1, F.concat("body", F.lit(" changed"))).otherwise(F.col("body")).alias("body"))
    known = d.where("block % 3 <> 2").withColumn("block", F.when(F.col("block") % 3 == 0, F.col("block") + 1_000_000).otherwise(F.col("block")))
    return resolve.resolved_ids(incoming, known.withColumn("owner_id", F.lit(None).cast("long")).withColumn("deleted", F.lit(False)))


@query("""SELECT event_type AS path, max_by(CASE WHEN user_id % 5 = 0 THEN 'name ' || user_id ELSE 'login ' || user_id END, (ts, event_id)) AS author FROM events GROUP BY event_type""")
def path_authors(spark, sf_dir):
    e = corpus.read(spark, sf_dir, "events")
    who = F.col("user_id").cast("string")
    return ingest.last_authors(e.select(F.col("event_type").alias("path"), F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("login "), who)).alias("login"), F.concat(F.lit("name "), who).alias("name"), "ts", F.col("event_id").alias("sha")))


@query("""SELECT CAST(page_id % 20 AS VARCHAR) AS repository, min_by('NOTICE' || CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '.txt' ELSE '.MD' END, page_id) AS path FROM pages WHERE page_id % 7 <> 0 AND page_id % 11 <> 0 GROUP BY 1""")
def notice_lookup(spark, sf_dir):
    p = corpus.read(spark, sf_dir, "pages")
    name = F.concat(F.when(F.col("page_id") % 7 == 0, "docs/NOTICE").otherwise("NOTICE"), F.element_at(F.array(F.lit(""), F.lit(".txt"), F.lit(".MD")), (F.col("page_id") % 3 + 1).cast("int")))
    size = F.when(F.col("page_id") % 11 == 0, 2_000_000).otherwise(10)
    return ingest.root_notice(p.select((F.col("page_id") % 20).cast("string").alias("repository"), name.alias("path"), size.alias("size"), F.col("page_id").alias("position")))


@query("""SELECT repository, path, CASE WHEN k = 0 THEN 'unsafe' WHEN k = 1 THEN 'missing' WHEN k = 2 THEN 'unsupported' ELSE 'candidate' END AS state FROM
    (SELECT CAST(page_id % 5 AS VARCHAR) AS repository, page_id % 4 AS k, CASE page_id % 4 WHEN 0 THEN '/' ELSE '' END || 'p' || page_id || CASE WHEN page_id % 4 = 2 THEN '.txt' ELSE '.kql' END AS path FROM pages)""")
def requested_paths(spark, sf_dir):
    p = corpus.read(spark, sf_dir, "pages")
    k = F.col("page_id") % 4
    path = F.concat(F.when(k == 0, "/").otherwise(""), F.lit("p"), F.col("page_id").cast("string"), F.when(k == 2, ".txt").otherwise(".kql"))
    rows = p.select((F.col("page_id") % 5).cast("string").alias("repository"), path.alias("path"), k.alias("k"))
    return ingest.requested_paths(rows.drop("k"), rows.where("k <> 1").drop("k"))


NAMES = ["octo/repo", "octo/..", "-a/b", "a/b/c", "a/b.c_d-e"]
REFS = ["main", "feature/x", "-x", "a..b", "v1.lock"]


@query(f"""SELECT event_id, event_id % 5 IN (0, 4) AS name_ok, event_id % 5 IN (0, 1) AS ref_ok FROM events""")
def name_checks(spark, sf_dir):
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("event_id") % 5 + 1).cast("int"))
    return corpus.read(spark, sf_dir, "events").select("event_id", ingest.is_repository_name(pick(NAMES)).alias("name_ok"), ingest.is_safe_ref(pick(REFS)).alias("ref_ok"))


@query(f"""WITH {SQL}, p AS (SELECT query_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('Purpose: [a](http://x) ' || kql, '!\\[([^\\]]*)\\]\\([^)]+\\)', '\\1', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '<[^>]+>', ' ', 'g'),
      '(?i)^(?:use\\s*case|purpose|description)\\s*:\\s*', ''), '[ \\t\\r\\n\\f]+', ' ', 'g')) AS t FROM corpus), s AS (SELECT query_id, t, CASE WHEN length(t) > 900 THEN regexp_replace(substr(t, 1, 897), '\\s+\\S*\\z', '') || '...' ELSE t END AS s FROM p)
    SELECT query_id, CASE WHEN length(t) < 8 THEN '' WHEN regexp_matches(s, '[.!?]\\z') THEN s ELSE s || '.' END AS description FROM s""")
def normalized_description(spark, sf_dir):
    text = F.concat(F.lit("Purpose: [a](http://x) "), "kql")
    return corpus.documents(spark, sf_dir).select("query_id", ingest.normalized_description(text).alias("description"))


@query(f"""WITH {SQL} SELECT query_id, CASE doc_id % 4 WHEN 0 THEN 'Finds risky sign-ins by correlating A, B, and C.' WHEN 1 THEN 'Queries A to investigate odd logons.' WHEN 2 THEN 'Runs odd logons in Sentinel.' ELSE 'Correlates A and B to investigate odd logons.' END AS description FROM corpus""")
def fallback_description(spark, sf_dir):
    k = F.col("doc_id") % 4
    title = F.when(k == 0, "find Risky sign-ins").otherwise("Odd logons")
    tables = F.when(k == 0, F.array(*map(F.lit, "ABCD"))).when(k == 1, F.array(F.lit("A"))).when(k == 3, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array().cast("array<string>"))
    return corpus.documents(spark, sf_dir).select("query_id", ingest.fallback_description(title, tables, F.lit("Sentinel")).alias("description"))


@query(f"""WITH {SQL} SELECT query_id FROM corpus WHERE contains(lower(concat_ws(' ', title, description, kql, dialect)), 'thtion') AND contains(lower(concat_ws(' ', title, description, kql, dialect)), 'sentinel') ORDER BY star_count DESC, query_id LIMIT 50""")
def terms_search(spark, sf_dir):
    from grainmill.operators.retrieval import all_terms

    rows = corpus.heads(spark, sf_dir).where(all_terms("  ThTion sentinel ", ["title", "description", "kql", "dialect"]))
    return rows.orderBy(F.desc("star_count"), "query_id").limit(50).select("query_id")


@query(f"""WITH {SQL} SELECT query_id, to_json({{'id': query_id, 'title': title, 'dialect': dialect, 'tables': tables, 'stars': star_count}})::VARCHAR AS record FROM corpus WHERE (visibility = 'public' AND moderation_status = 'visible' AND NOT deleted)""")
def json_records(spark, sf_dir):
    rows = corpus.heads(spark, sf_dir).where(public())
    return rows.select("query_id", F.to_json(F.struct(F.col("query_id").alias("id"), "title", "dialect", "tables", F.col("star_count").alias("stars")), {"ignoreNullFields": "false"}).alias("record"))
