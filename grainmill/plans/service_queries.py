"""The search service from request to outcome, over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.operators import retrieval, search_service, state
from grainmill.operators.request import Request
from grainmill.operators.visibility import readable, search_filters
from grainmill.plans.catalogue import query
from grainmill.plans.search_queries import MERGED, NOW, RANKED, SCORED, SIM, SPACE_SQL, TERMS, VIEWER, _index, _query_vector
from grainmill.sources import corpus
from grainmill.sources.corpus import SQL

#: A word that nearly all documents have, so that lexical hits say little; and a filter that lexical and authorised rows must both pass.
REQUEST = Request("th", {"dialects": ["sentinel", "defender-xdr"]})
FITS = "c.dialect IN ('sentinel', 'defender-xdr')"
CANDIDATES = f"""near AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY round(s, 9) DESC, vec_id) AS k FROM (SELECT {SPACE_SQL} AS namespace, vec_id, {SIM} AS s FROM embeddings)
  WHERE namespace IN ('public', 'private:{VIEWER}')),
cand AS (SELECT CAST(vec_id AS VARCHAR) AS query_id, CAST(vec_id AS VARCHAR) || '-v1' AS version_id, s FROM near WHERE k <= 40),
sem AS"""


def _replaced(sql: str, old: str, new: str) -> str:
    if old not in sql:
        raise ValueError(old)
    return sql.replace(old, new)


MATCHED = _replaced(RANKED, "['thtion', 'attion', 'ontion']", f"['{REQUEST.q}']")
HITS = _replaced(SCORED.replace(TERMS, REQUEST.q), "JOIN corpus c USING (doc_id) WHERE ", f"JOIN corpus c USING (doc_id) WHERE {FITS} AND ")
MERGED_BY_SPACE = _replaced(CANDIDATES + MERGED.partition("sem AS")[2], "USING (query_id, version_id) WHERE ", f"USING (query_id, version_id) WHERE {FITS} AND ")
TOLD = "(SELECT n > 0 AND (a >= 0.74 OR (a >= 0.64 AND a - b >= 0.12)) FROM (SELECT count(*) AS n, coalesce(max(score), 0) AS a, coalesce(max(CASE WHEN k = 2 THEN score END), 0) AS b FROM (SELECT score, row_number() OVER (ORDER BY score DESC) AS k FROM {})))"
MODE = "(SELECT CASE WHEN bool_or(match_type = 'hybrid') THEN 'hybrid' WHEN bool_or(match_type = 'semantic') THEN 'semantic' ELSE 'lexical' END FROM page)"


def stages(spark, sf_dir, **other) -> search_service.Stages:
    """The stages over the tables; the first vector stands for what an embedding model would give for any text."""
    vectors = corpus.read(spark, sf_dir, "embeddings")
    fits = search_filters(**REQUEST.filters)
    space = state.namespace(F.when(F.col("label") % 2 == 0, "public").otherwise("private"), F.col("vec_id") % 150)

    def lexical(request):
        return retrieval.lexical(corpus.heads(spark, sf_dir), corpus.documents(spark, sf_dir), _index(spark, sf_dir), request.q, readable(VIEWER), F.lit(NOW).cast("timestamp_ntz"), fits, request.limit)

    def semantic(name, vector, limit):
        near = retrieval.top_k(vectors.withColumn("namespace", space).where(F.col("namespace") == name), vector, limit)
        return near.select(F.col("vec_id").cast("string").alias("query_id"), F.concat(F.col("vec_id").cast("string"), F.lit("-v1")).alias("version_id"), "score")

    def authorised(ids):
        return corpus.heads(spark, sf_dir).where(readable(VIEWER) & fits).join(F.broadcast(ids), "query_id", "left_semi")  # 100 ids at most

    own = {"lexical": lexical, "embed": lambda text: _query_vector(vectors), "semantic": semantic, "authorised": authorised}
    return search_service.Stages(**(own | other))


@query(f"""WITH {SQL}, {MATCHED}, {HITS}, {MERGED_BY_SPACE}, told AS (SELECT {TOLD.format('hits')} AS at_once, {TOLD.format('final')} AS at_last),
    page AS (SELECT query_id, version_id, match_type, score, star_count FROM final, told WHERE NOT at_once UNION ALL SELECT query_id, version_id, 'lexical', score, star_count FROM hits, told WHERE at_once)
    SELECT query_id, version_id, match_type, round(score, 6) AS score, star_count, row_number() OVER (ORDER BY round(score, 9) DESC, star_count DESC, query_id) AS place, {MODE} AS mode,
      CASE WHEN at_once THEN 'lexical' ELSE 'lexical intent embedding semantic authorization' END AS attempted, CASE WHEN NOT at_once AND NOT at_last THEN 'retrieval-inadequate' END AS fallback, 0 AS issues FROM page, told""")
def search_outcome(spark, sf_dir):
    found = search_service.search(REQUEST, VIEWER, stages(spark, sf_dir))
    return found.results.select(
        "query_id", "version_id", "match_type", F.round("score", 6).alias("score"), "star_count", "place", F.lit(found.mode).alias("mode"), F.lit(" ".join(found.attempted)).alias("attempted"),
        F.lit(found.fallback and found.fallback.reason).cast("string").alias("fallback"), F.lit(len(found.issues)).alias("issues"),
    )
