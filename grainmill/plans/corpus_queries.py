"""Projections, feeds, joins, stars, reports and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions.text import strip_strings
from grainmill.operators import cursors, feeds, state
from grainmill.operators.retrieval import current_hits
from grainmill.operators.visibility import any_of, array_has, feed_rule, public, readable, search_filters
from grainmill.plans.catalogue import query
from grainmill.sources import corpus
from grainmill.sources.corpus import SQL

ISO = corpus.SQL_ISO.format("updated_at")
VIEWER = 7
def item():
    return ["query_id", "title", "dialect", "visibility", "star_count", feeds.iso("updated_at").alias("updated_at")]



ITEM_SQL = f"query_id, title, dialect, visibility, star_count, {ISO} AS updated_at"


@query(f"""WITH {SQL} SELECT {ITEM_SQL}, version_id, description, length(kql) AS body_length, array_to_string(tables, ' ') AS tables, repository, trusted,
    owner_id, EXISTS (SELECT 1 FROM star_rows s WHERE s.doc_id = corpus.doc_id AND s.user_id = {VIEWER}) AS starred_by_viewer
    FROM corpus WHERE {corpus.SQL_READABLE.format(c='', viewer=VIEWER)}""")
def detail_projection(spark, sf_dir):
    rows = feeds.detail(corpus.heads(spark, sf_dir), corpus.stars(spark, sf_dir), VIEWER)
    return rows.select(*item(), "version_id", "description", F.length("kql").cast("long").alias("body_length"), F.array_join("tables", " ").alias("tables"), "repository", "trusted", "owner_id", "starred_by_viewer")


@query("SELECT CAST(doc_id AS VARCHAR) AS query_id, trim(substr(split_part(text, chr(10), 1), 1, 180)) AS title, substr(text, 1, 480) AS preview, false AS starred_by_viewer FROM documents")
def list_projection(spark, sf_dir):
    return corpus.documents(spark, sf_dir).select("query_id", "title", F.substring("kql", 1, 480).alias("preview"), F.lit(False).alias("starred_by_viewer"))


@query(f"""WITH {SQL} SELECT query_id, coalesce(nullif(trim(description), ''), trim(regexp_replace(substr(kql, 1, 480), '[ \\t\\r\\n]+', ' ', 'g'))) AS description FROM corpus WHERE (visibility = 'public' AND moderation_status = 'visible' AND NOT deleted)""")
def public_preview(spark, sf_dir):
    rows = corpus.labelled(corpus.documents(spark, sf_dir), spark, sf_dir)
    return rows.where(public()).select("query_id", feeds.preview_description().alias("description"))


@query(f"WITH {SQL} SELECT query_id, repository AS source_name, 'https://host.example/' || repository AS source_url, trusted FROM corpus WHERE repository IS NOT NULL")
def provenance_record(spark, sf_dir):
    rows = corpus.labelled(corpus.documents(spark, sf_dir), spark, sf_dir).select("query_id", feeds.provenance().alias("p"))
    return rows.where("p is not null").select("query_id", F.col("p.name").alias("source_name"), F.col("p.url").alias("source_url"), F.col("p.trusted").alias("trusted"))


@query(f"WITH {SQL} SELECT query_id, visibility, owner_id FROM corpus WHERE {corpus.SQL_READABLE.format(c='', viewer=VIEWER)}")
def visibility_filter(spark, sf_dir):
    rows = corpus.labelled(corpus.documents(spark, sf_dir), spark, sf_dir)
    return rows.where(readable(VIEWER)).select("query_id", "visibility", "owner_id")


@query(f"WITH {SQL} SELECT {ITEM_SQL} FROM corpus WHERE owner_id = {VIEWER} AND NOT deleted ORDER BY corpus.updated_at DESC, query_id DESC LIMIT 26")
def owned_feed_page(spark, sf_dir):
    return feeds.owned(corpus.heads(spark, sf_dir), VIEWER).select(*item())


@query(f"""WITH {SQL} SELECT {ITEM_SQL} FROM corpus JOIN star_rows USING (doc_id) WHERE user_id = {VIEWER} AND (visibility = 'public' AND moderation_status = 'visible' AND NOT deleted)
    ORDER BY corpus.updated_at DESC, query_id DESC LIMIT 26""")
def starred_feed_page(spark, sf_dir):
    return feeds.starred(corpus.heads(spark, sf_dir), corpus.stars(spark, sf_dir), VIEWER).select(*item())


@query(f"WITH {SQL} SELECT {ITEM_SQL} FROM corpus WHERE (visibility = 'public' AND moderation_status = 'visible' AND NOT deleted) ORDER BY star_count DESC, corpus.updated_at DESC, query_id DESC LIMIT 21")
def public_feed_page(spark, sf_dir):
    return feeds.public_feed(corpus.heads(spark, sf_dir)).select(*item())


@query(f"""WITH {SQL}, c AS (SELECT * FROM (SELECT star_count, updated_at, query_id FROM corpus WHERE (visibility = 'public' AND moderation_status = 'visible' AND NOT deleted) ORDER BY star_count DESC, updated_at DESC, query_id DESC LIMIT 20)
      ORDER BY star_count, updated_at, query_id LIMIT 1)
    SELECT {ITEM_SQL.replace("query_id", "corpus.query_id").replace("star_count", "corpus.star_count").replace("strftime(updated_at", "strftime(corpus.updated_at")} FROM corpus, c WHERE (visibility = 'public' AND moderation_status = 'visible' AND NOT deleted) AND
      (corpus.star_count < c.star_count OR (corpus.star_count = c.star_count AND (corpus.updated_at < c.updated_at OR (corpus.updated_at = c.updated_at AND corpus.query_id < c.query_id))))
    ORDER BY corpus.star_count DESC, corpus.updated_at DESC, corpus.query_id DESC LIMIT 21""")
def public_feed_page2(spark, sf_dir):
    heads = corpus.heads(spark, sf_dir)
    first = feeds.public_feed(heads).take(20)  # a page
    if not first:
        return feeds.public_feed(heads).select(*item())
    last = first[-1]
    return feeds.public_feed(heads, (last["star_count"], last["updated_at"], last["query_id"])).select(*item())


@query(f"""WITH {SQL} SELECT query_id, CAST(star_count AS VARCHAR) || '%7C' || replace({ISO}, ':', '%3A') || '%7C' || query_id AS cursor FROM corpus""")
def ranked_cursor(spark, sf_dir):
    return corpus.heads(spark, sf_dir).select("query_id", cursors.encode(F.col("star_count"), feeds.iso("updated_at"), F.col("query_id")).alias("cursor"))


@query(f"WITH {SQL} SELECT query_id, {ISO} AS updated_at FROM corpus WHERE (visibility = 'public' AND moderation_status = 'visible' AND NOT deleted) ORDER BY corpus.updated_at DESC, query_id DESC LIMIT 50000")
def sitemap(spark, sf_dir):
    rows = feeds.sitemap(corpus.labelled(corpus.documents(spark, sf_dir), spark, sf_dir))
    return rows.select("query_id", feeds.iso("updated_at").alias("updated_at"))


HISTORY = "SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS history_id, conv_id % 150 AS user_id, text AS raw_request, TIMESTAMP '2024-01-01' + to_minutes(conv_id) + to_seconds(turn) AS created_at FROM conversations WHERE role = 'user'"


@query(f"SELECT history_id, raw_request, {corpus.SQL_ISO.format('created_at')} AS created_at FROM ({HISTORY}) t WHERE user_id = {VIEWER} ORDER BY t.created_at DESC, history_id DESC LIMIT 26")
def history_page(spark, sf_dir):
    rows = feeds.history(state.search_history(corpus.read(spark, sf_dir, "conversations")).where(F.col("user_id") == VIEWER))
    return rows.select("history_id", "raw_request", feeds.iso("created_at").alias("created_at"))


@query(f"""WITH {SQL}, h AS ({HISTORY}) SELECT history_id, CASE WHEN c.doc_id IS NOT NULL THEN c.query_id END AS clicked_query_id
    FROM h LEFT JOIN corpus c ON c.doc_id = length(raw_request) AND (NOT c.deleted AND ((c.visibility = 'public' AND c.moderation_status = 'visible') OR c.owner_id = h.user_id))""")
def click_through_guard(spark, sf_dir):
    rows = state.search_history(corpus.read(spark, sf_dir, "conversations")).withColumn("doc_id", F.length("raw_request").cast("long"))
    heads = corpus.labelled(corpus.documents(spark, sf_dir), spark, sf_dir)
    return state.guarded_clicks(rows, heads).select("history_id", "clicked_query_id")


@query(f"WITH {SQL} SELECT query_id, star_count FROM corpus")
def star_counts(spark, sf_dir):
    return corpus.heads(spark, sf_dir).select("query_id", "star_count")


@query(f"WITH {SQL} SELECT user_id, s.doc_id FROM star_rows s JOIN corpus c ON s.doc_id = c.doc_id WHERE (c.visibility = 'public' AND c.moderation_status = 'visible' AND NOT c.deleted)")
def star_cascade(spark, sf_dir):
    heads = corpus.labelled(corpus.documents(spark, sf_dir), spark, sf_dir)
    return state.surviving_stars(corpus.stars(spark, sf_dir), heads).select("user_id", "doc_id")


@query(f"""WITH {SQL}, r AS (SELECT r.*, row_number() OVER (PARTITION BY user_id, r.doc_id ORDER BY r.ts, event_id) AS k FROM report_rows r JOIN corpus c ON r.doc_id = c.doc_id WHERE (c.visibility = 'public' AND c.moderation_status = 'visible' AND NOT c.deleted))
    SELECT event_id, user_id, doc_id FROM r WHERE k = 1""")
def open_report_dedupe(spark, sf_dir):
    heads = corpus.labelled(corpus.documents(spark, sf_dir), spark, sf_dir)
    return state.open_reports(corpus.reports(spark, sf_dir), heads).select("event_id", "user_id", "doc_id")


@query(f"""WITH {SQL}, hit AS (SELECT doc_id, count(*) AS n FROM report_rows GROUP BY doc_id HAVING count(*) >= 3)
    SELECT r.event_id, CASE WHEN h.doc_id IS NOT NULL THEN 'actioned' ELSE 'open' END AS status, CASE WHEN h.doc_id IS NOT NULL THEN 'unpublished' ELSE 'visible' END AS moderation_status
    FROM report_rows r LEFT JOIN hit h ON r.doc_id = h.doc_id""")
def unpublish_actions(spark, sf_dir):
    rows = corpus.reports(spark, sf_dir)
    hit = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("doc_id")
    return state.unpublish(rows, hit).select("event_id", "status", "moderation_status")


@query(f"""WITH {SQL}, j AS (SELECT query_id, CAST(to_json(tags) AS VARCHAR) AS tags_json FROM corpus),
    m AS (SELECT query_id, unnest(from_json(tags_json, '["VARCHAR"]')) AS tag FROM j) SELECT DISTINCT query_id FROM m WHERE starts_with(lower(tag), 'at') OR lower(tag) IN ('thousand', 'attention')""")
def json_any_filter(spark, sf_dir):
    rows = corpus.documents(spark, sf_dir).select("query_id", F.to_json("tags").alias("tags_json"))
    members = strip_strings(F.col("tags_json"))
    return rows.where(F.exists(members, lambda x: F.lower(x).startswith("at") | any_of(F.lower(x), ["thousand", "attention"]))).select("query_id")


@query(f"""WITH {SQL} SELECT query_id FROM (SELECT *, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE owner_id END AS owner, CASE WHEN repository LIKE '%1%' THEN 'local' ELSE 'github' END AS provider FROM corpus)
    WHERE {corpus.SQL_PUBLIC.format(c='')} AND (owner IS NOT NULL OR provider = 'github')""")
def public_feed_rule(spark, sf_dir):
    rows = corpus.labelled(corpus.documents(spark, sf_dir), spark, sf_dir)
    rows = rows.withColumns({"owner_id": F.when(F.col("doc_id") % 6 != 0, F.col("owner_id")), "provider": F.when(F.contains("repository", F.lit("1")), "local").otherwise("github")})
    return rows.where(feed_rule()).select("query_id")


@query(f"""WITH {SQL}, i AS (SELECT query_id, CASE WHEN length(kql) % 4 = 0 THEN query_id || '-v0' ELSE version_id END AS version_id FROM corpus)
    SELECT i.query_id, i.version_id FROM i JOIN corpus c ON c.query_id = i.query_id AND c.version_id = i.version_id WHERE {corpus.SQL_READABLE.format(c='c.', viewer=VIEWER)}""")
def current_version_guard(spark, sf_dir):
    heads = corpus.labelled(corpus.documents(spark, sf_dir), spark, sf_dir)
    index = heads.select("query_id", F.when(F.length("kql") % 4 == 0, F.concat("query_id", F.lit("-v0"))).otherwise(F.col("version_id")).alias("version_id"))
    return current_hits(index, heads.where(readable(VIEWER))).select("query_id", "version_id")


@query(f"""WITH {SQL}, c AS (SELECT updated_at, query_id FROM corpus WHERE owner_id = {VIEWER} AND NOT deleted ORDER BY updated_at DESC, query_id DESC LIMIT 1 OFFSET 2)
    SELECT {ITEM_SQL.replace("query_id", "corpus.query_id").replace("strftime(updated_at", "strftime(corpus.updated_at")} FROM corpus, c WHERE owner_id = {VIEWER} AND NOT deleted
      AND (corpus.updated_at < c.updated_at OR (corpus.updated_at = c.updated_at AND corpus.query_id < c.query_id)) ORDER BY corpus.updated_at DESC, corpus.query_id DESC LIMIT 26""")
def owned_feed_page2(spark, sf_dir):
    heads = corpus.heads(spark, sf_dir)
    first = feeds.owned(heads, VIEWER).take(3)  # a page of three
    if len(first) < 3:
        return feeds.owned(heads, VIEWER).limit(0).select(*item())
    return feeds.owned(heads, VIEWER, (first[2]["updated_at"], first[2]["query_id"])).select(*item())


@query(f"""WITH {SQL} SELECT query_id FROM corpus WHERE dialect IN ('sentinel', 'defender-xdr') AND len([x for x in operators if x LIKE 't%']) > 0 AND lower(repository) IN ('src1', 'src2', 'src3')""")
def search_filters_query(spark, sf_dir):
    rows = corpus.documents(spark, sf_dir)
    return rows.where(search_filters(dialects=["sentinel", "defender-xdr"], sources=["SRC1", "src2", "src3"]) & F.exists("operators", lambda x: x.startswith("t"))).select("query_id")


@query(f"""WITH {SQL}, w AS (SELECT word FROM (SELECT unnest(tags) AS word FROM corpus) GROUP BY word ORDER BY count(*) DESC, word LIMIT 5)
    SELECT DISTINCT query_id FROM (SELECT query_id, unnest(tags) AS word FROM corpus) JOIN w USING (word)""")
def tag_any_match(spark, sf_dir):
    rows = corpus.documents(spark, sf_dir)
    top = rows.select(F.explode("tags").alias("word")).groupBy("word").count().orderBy(F.desc("count"), "word").limit(5)
    words = [r["word"].upper() for r in top.collect()]  # five filter values
    return rows.where(array_has("tags", words)).select("query_id")


@query(f"""WITH {SQL}, ids AS (SELECT CAST(query_id AS BIGINT) AS doc_id, row_number() OVER (ORDER BY place) AS place FROM (SELECT query_id, min(place) AS place FROM
      (SELECT CAST((i * 37) % n AS VARCHAR) AS query_id, i AS place FROM n_docs, generate_series(0, 249) t(i)) GROUP BY query_id ORDER BY place LIMIT 200))
    SELECT c.query_id, ids.place FROM ids JOIN corpus c ON c.doc_id = ids.doc_id WHERE {corpus.SQL_READABLE.format(c='c.', viewer=VIEWER)}""")
def candidate_order(spark, sf_dir):
    n = corpus.read(spark, sf_dir, "documents").count()
    ids = list(dict.fromkeys(i * 37 % n for i in range(250)))
    heads = corpus.labelled(corpus.documents(spark, sf_dir), spark, sf_dir)
    return state.in_given_order(heads.where(readable(VIEWER)), ids).select("query_id", "place")


@query(f"""WITH {SQL} SELECT (SELECT count(*) FROM corpus) AS queries, (SELECT count(*) FROM corpus WHERE version_id IS NOT NULL) AS versions, (SELECT count(DISTINCT repository) FROM corpus) AS repositories,
    (SELECT count(*) FROM star_rows) AS stars, (SELECT count(*) FROM report_rows) AS reports, (SELECT count(DISTINCT owner_id) FROM corpus) AS owners, (SELECT count(*) FROM conversations WHERE role = 'user') AS searches""")
def totals(spark, sf_dir):
    d = corpus.documents(spark, sf_dir)
    out = d.agg(F.count(F.lit(1)).alias("queries"), F.count("version_id").alias("versions"), F.count_distinct("repository").alias("repositories"), F.count_distinct("owner_id").alias("owners"))
    others = {"stars": corpus.stars(spark, sf_dir), "reports": corpus.reports(spark, sf_dir), "searches": corpus.read(spark, sf_dir, "conversations").where("role = 'user'")}
    for name, rows in others.items():
        out = out.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias(name))))  # one row each
    return out
