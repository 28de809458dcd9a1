"""Index, lexical, vector and hybrid search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from grainmill.functions.text import ACCENTS
from grainmill.operators import retrieval, state
from grainmill.operators.visibility import readable
from grainmill.plans.catalogue import query
from grainmill.sources import corpus
from grainmill.sources.corpus import SQL

TERMS = "thtion attion ontion"
VIEWER = 7
NOW = "2024-01-02 00:00:00"
FIELDS = {"title": "title", "tables": "array_to_string(tables, ' ')", "description": "description", "kql": "kql", "operators": "array_to_string(operators, ' ')", "tags": "array_to_string(tags, ' ')", "author": "repository", "repository": "repository"}
TOK = lambda f: f"regexp_extract_all(translate(lower(coalesce({f}, '')), '{ACCENTS[0]}', '{ACCENTS[1]}'), '[\\p{{L}}\\p{{N}}]+')"
ALL_FIELDS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS field, CAST({retrieval.WEIGHTS[k]} AS DOUBLE) AS w, unnest({TOK(v)}) AS term FROM corpus" for k, v in FIELDS.items())
RANKED = f"""tok AS ({ALL_FIELDS}),
len AS (SELECT doc_id, count(*) AS len FROM tok GROUP BY doc_id),
stat AS (SELECT (SELECT count(*) FROM corpus) AS n, sum(len) * 1.0 / (SELECT count(*) FROM corpus) AS avg_len FROM len),
q AS (SELECT unnest(['thtion', 'attion', 'ontion']) AS q),
f AS (SELECT doc_id, q, sum(w) AS f FROM tok JOIN q ON starts_with(term, q) GROUP BY doc_id, q),
idf AS (SELECT q, greatest(ln(((SELECT n FROM stat) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM f GROUP BY q),
ranked AS (SELECT doc_id, sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avg_len))) AS rank FROM f JOIN idf USING (q) JOIN len USING (doc_id), stat GROUP BY doc_id)"""
SCORED = f"""scored AS (SELECT c.*, least(1.0, rank / (1 + rank) + CASE WHEN lower(title) = '{TERMS}' THEN 0.22 ELSE 0 END + CASE WHEN list_contains(tables, '{TERMS}') THEN 0.12 ELSE 0 END
  + CASE WHEN trusted THEN 0.03 ELSE 0 END + CASE WHEN star_count >= 100 THEN 0.05 WHEN star_count >= 20 THEN 0.035 WHEN star_count >= 5 THEN 0.02 ELSE 0 END
  + CASE WHEN epoch_us(TIMESTAMP '{NOW}') - epoch_us(c.updated_at) <= 30 * 86400000000 THEN 0.015 ELSE 0 END) AS score FROM ranked JOIN corpus c USING (doc_id) WHERE {corpus.SQL_READABLE.format(c='', viewer=VIEWER)}),
hits AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, star_count DESC, updated_at DESC, query_id) AS place FROM scored QUALIFY place <= 20)"""


_INDEXES: dict[tuple, str] = {}


def _index(spark, sf_dir):
    """The stored index of a folder's documents, built once a session for each state of its files (paths, sizes, times)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{sf_dir}/documents.parquet")
    state_of = files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("path", "length", "modificationTime")))  # contents are not read
    key = (spark.sparkContext.applicationId, sf_dir, *state_of.first())
    if key not in _INDEXES:
        _INDEXES[key] = retrieval.build_index(retrieval.index_documents(corpus.documents(spark, sf_dir)))
    return _INDEXES[key]


def _hits(spark, sf_dir):
    now = F.lit(NOW).cast("timestamp_ntz")
    return retrieval.lexical(corpus.heads(spark, sf_dir), corpus.documents(spark, sf_dir), _index(spark, sf_dir), TERMS, readable(VIEWER), now)


def _placed(hits):
    order = Window.orderBy(F.desc(F.round("score", 9)), F.desc("star_count"), F.desc("updated_at"), "query_id")
    return hits.withColumn("place", F.row_number().over(order))  # 20 rows


@query(f"""WITH {SQL} SELECT query_id, version_id, title, array_to_string(tables, ' ') AS tables, description, sha256(kql) AS kql_hash, array_to_string(operators, ' ') AS operators, array_to_string(tags, ' ') AS tags, repository AS author, repository
    FROM corpus""")
def index_documents(spark, sf_dir):
    rows = retrieval.index_documents(corpus.documents(spark, sf_dir))
    return rows.withColumn("kql_hash", F.sha2("kql", 256)).drop("kql", "doc_id")


@query(f"WITH {SQL}, tok AS ({ALL_FIELDS}) SELECT doc_id, field, term, count(*) AS tf FROM tok GROUP BY ALL")
def postings(spark, sf_dir):
    return retrieval.postings(retrieval.index_documents(corpus.documents(spark, sf_dir)))


@query(f"WITH {SQL}, {RANKED} SELECT doc_id, round(rank, 6) AS rank FROM ranked")
def bm25_scores(spark, sf_dir):
    return retrieval.bm25(spark, _index(spark, sf_dir), retrieval.match_terms(TERMS)).select("doc_id", F.round("rank", 6).alias("rank"))


@query(f"""WITH {SQL}, {RANKED}, {SCORED} SELECT query_id, version_id, title, CASE WHEN length(trim(description)) > 0 THEN substr(description, 1, 360) ELSE substr(kql, 1, 360) END AS snippet,
    star_count, round(score, 6) AS score FROM hits""")
def lexical_search(spark, sf_dir):
    from grainmill.operators.feeds import snippet

    return _hits(spark, sf_dir).select("query_id", "version_id", "title", snippet().alias("snippet"), "star_count", F.round("score", 6).alias("score"))


@query(f"""WITH {SQL}, {RANKED}, {SCORED}, s AS (SELECT coalesce(max(score), 0) AS a, coalesce(max(CASE WHEN place = 2 THEN score END), 0) AS b, count(*) AS n FROM hits)
    SELECT n > 0 AND (a >= 0.74 OR (a >= 0.64 AND a - b >= 0.12)) AS adequate, round(a, 6) AS confidence,
      CASE WHEN n = 0 THEN 'no-results' WHEN a >= 0.74 THEN 'strong-score' WHEN a >= 0.64 AND a - b >= 0.12 THEN 'clear-leading-result' ELSE 'weak-score' END AS reason FROM s""")
def adequacy(spark, sf_dir):
    return retrieval.adequacy(_placed(_hits(spark, sf_dir)), TERMS).select("adequate", F.round("confidence", 6).alias("confidence"), "reason")


QV = "(SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"
SIM = f"greatest(0.0, least(1.0, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({QV} AS DOUBLE[]))))"


def _query_vector(vectors):
    first = vectors.orderBy("vec_id").select("embedding").first()  # one vector
    return first["embedding"] if first else []


@query(f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, {SIM} AS s FROM embeddings) ORDER BY round(s, 9) DESC, vec_id LIMIT 40")
def vector_topk(spark, sf_dir):
    v = corpus.read(spark, sf_dir, "embeddings")
    return retrieval.top_k(v, _query_vector(v), 40).select("vec_id", F.round("score", 6).alias("score"))


SPACE_SQL = f"CASE WHEN label % 2 = 0 THEN 'public' ELSE 'private:' || CAST(vec_id % 150 AS VARCHAR) END"


@query(f"""SELECT namespace, vec_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY round(s, 9) DESC, vec_id) AS k FROM
    (SELECT {SPACE_SQL} AS namespace, vec_id, {SIM} AS s FROM embeddings)) WHERE namespace IN ('public', 'private:{VIEWER}') AND k <= 10""")
def namespace_topk(spark, sf_dir):
    v = corpus.read(spark, sf_dir, "embeddings")
    space = state.namespace(F.when(F.col("label") % 2 == 0, "public").otherwise("private"), F.col("vec_id") % 150)
    q, out = _query_vector(v), None
    for name in retrieval.namespaces(VIEWER):
        one = retrieval.top_k(v.withColumn("namespace", space).where(F.col("namespace") == name), q, 10)
        out = one if out is None else out.unionByName(one)
    return out.select("namespace", "vec_id", F.round("score", 6).alias("score"))


MERGED = f"""cand AS (SELECT CAST(vec_id AS VARCHAR) AS query_id, CAST(vec_id AS VARCHAR) || '-v1' AS version_id, s FROM (SELECT vec_id, {SIM} AS s FROM embeddings) ORDER BY round(s, 9) DESC, vec_id LIMIT 40),
sem AS (SELECT c.query_id, c.version_id, c.star_count, cand.s FROM cand JOIN corpus c USING (query_id, version_id) WHERE {corpus.SQL_READABLE.format(c='', viewer=VIEWER)}),
merged AS (SELECT coalesce(h.query_id, sem.query_id) AS query_id, coalesce(h.version_id, sem.version_id) AS version_id,
  CASE WHEN h.query_id IS NOT NULL AND cand.s IS NOT NULL THEN 'hybrid' WHEN h.query_id IS NOT NULL THEN 'lexical' ELSE 'semantic' END AS match_type,
  CASE WHEN h.query_id IS NOT NULL AND cand.s IS NOT NULL THEN least(1.0, h.score * 0.62 + cand.s * 0.38 + 0.06) WHEN h.query_id IS NOT NULL THEN h.score ELSE sem.s END AS score,
  coalesce(h.star_count, sem.star_count) AS star_count
  FROM hits h FULL JOIN sem ON h.query_id = sem.query_id LEFT JOIN cand ON cand.query_id = coalesce(h.query_id, sem.query_id)),
final AS (SELECT * FROM merged ORDER BY round(score, 9) DESC, star_count DESC, query_id LIMIT 20)"""


def _merged(spark, sf_dir):
    v = corpus.read(spark, sf_dir, "embeddings")
    near = retrieval.top_k(v, _query_vector(v), 40)
    place = F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "vec_id"))  # 40 rows
    near = near.select(F.col("vec_id").cast("string").alias("query_id"), F.concat(F.col("vec_id").cast("string"), F.lit("-v1")).alias("version_id"), "score", place.alias("place"))
    heads = corpus.heads(spark, sf_dir).where(readable(VIEWER))
    allowed = heads.join(F.broadcast(near.select("query_id")), "query_id", "left_semi")  # 40 rows
    return retrieval.hybrid(_hits(spark, sf_dir), allowed, near)


@query(f"WITH {SQL}, {RANKED}, {SCORED}, {MERGED} SELECT query_id, version_id, match_type, round(score, 6) AS score, star_count FROM final")
def hybrid_merge(spark, sf_dir):
    return _merged(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"WITH {SQL}, {RANKED}, {SCORED}, {MERGED} SELECT CASE WHEN bool_or(match_type = 'hybrid') THEN 'hybrid' WHEN bool_or(match_type = 'semantic') THEN 'semantic' WHEN bool_or(match_type = 'lexical') THEN 'lexical' ELSE 'none' END AS mode FROM final")
def retrieval_mode(spark, sf_dir):
    return retrieval.retrieval_mode(_merged(spark, sf_dir))
