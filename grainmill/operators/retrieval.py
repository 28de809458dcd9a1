"""Full-text index, BM25, lexical and vector search, hybrid ranking and adequacy.

The index is stored: postings by term, which a search prunes to its prefixes, so it reads and aggregates only what matches. Constants of BM25 are the usual k1 = 1.2 and b = 0.75.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions.text import ACCENTS
from grainmill.sources.scratch import new_folder, written

#: Weights of the index fields; fixed values.
WEIGHTS = {"title": 12.0, "tables": 8.0, "description": 4.0, "kql": 1.0, "operators": 6.0, "tags": 5.0, "author": 3.0, "repository": 3.0}
K1, B = 1.2, 0.75


def match_terms(query: str) -> list[str]:
    """Prefix terms of a request: words of two characters or more, the first 16, then distinct; accents and underscores fall as in the index."""
    words = re.findall(r"[^\W]+", unicodedata.normalize("NFKC", query).lower())
    terms = list(dict.fromkeys([w for w in words if len(w) > 1][:16]))
    bare = lambda w: w.translate(str.maketrans(*ACCENTS))
    return list(dict.fromkeys(part for t in terms for part in bare(t).split("_") if part))


def tokens(text: Column) -> Column:
    """Index tokens: lower case, without accents, letters and digits of any script. Plain ASCII needs neither accents nor scripts."""
    found = lambda x, pattern: F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, found(F.lower(text), "\\p{Alnum}+")).otherwise(found(F.translate(F.lower(text), *ACCENTS), "[\\p{L}\\p{N}]+"))


def index_documents(heads: DataFrame) -> DataFrame:
    """One row of text fields for each document; private ones too, for search applies visibility."""
    return heads.select(
        "doc_id", "query_id", "version_id", "title", F.array_join("tables", " ").alias("tables"), "description", "kql",
        F.array_join("operators", " ").alias("operators"), F.array_join("tags", " ").alias("tags"), F.col("repository").alias("author"), "repository",
    )


def _fields(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, the number of a field, its tokens)."""
    parts = F.array(*(F.struct(F.lit(i).alias("field"), tokens(F.coalesce(f, F.lit(""))).alias("tokens")) for i, f in enumerate(WEIGHTS)))
    return docs.select("doc_id", F.explode(parts).alias("p")).select("doc_id", "p.field", "p.tokens")


def postings(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, field, term, tf). A document's field is one row, so its terms are counted there and nothing is shuffled.

    Spark makes the tokens; 2,000 fields at a time are grouped as Arrow columns. A row for each field keeps the batches
    that Spark hands over small, and a field travels as its number.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                ids, field, tokens = batch.slice(at, 2000).columns
                row = np.repeat(np.arange(len(ids), dtype="int32"), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
                every = pa.table({"row": row, "term": pc.list_flatten(tokens)})
                got = every.group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
                cols = [ids.take(r := got["row"]), field.take(r), got["term"], got["count_all"]]
                yield from pa.table(cols, names=["doc_id", "field", "term", "tf"]).to_batches(50_000)
                del row, every, got, cols, r
            pa.default_memory_pool().release_unused()

    counted = _fields(docs).mapInArrow(run, f"doc_id {kind}, field int, term string, tf long")
    return counted.withColumn("field", F.get(F.array(*(F.lit(f) for f in WEIGHTS)), "field"))


def weighed_terms(docs: DataFrame) -> DataFrame:
    """Rows (term, doc_id, weight, tf, len): a term's weights over the fields of a document. All of a document is in its row, so nothing is shuffled.

    Spark makes the tokens; 1,000 documents at a time are grouped as Arrow columns.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    weights = list(WEIGHTS.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                rows = [np.repeat(np.arange(b.num_rows), pc.list_value_length(c).to_numpy(zero_copy_only=False)) for c in b.columns[1:]]
                length = np.bincount(np.concatenate(rows), minlength=b.num_rows)
                every = pa.table({
                    "row": np.concatenate(rows), "term": pa.chunked_array([pc.list_flatten(c) for c in b.columns[1:]]), "w": np.repeat(weights, [len(r) for r in rows]),
                })
                got = every.group_by(["row", "term"]).aggregate([("w", "sum"), ("w", "count")]).combine_chunks()
                row = got["row"].to_numpy()
                cols = [got["term"], b.column(0).take(pa.array(row)), got["w_sum"], got["w_count"], pa.array(length[row])]
                yield from pa.table(cols, names=["term", "doc_id", "weight", "tf", "len"]).to_batches()

    toks = docs.select("doc_id", *(tokens(F.coalesce(f, F.lit(""))).alias(f) for f in WEIGHTS))
    return toks.mapInArrow(run, f"term string, doc_id {kind}, weight double, tf long, len long")


def build_index(docs: DataFrame) -> str:
    """Writes the inverted index of index documents to a new shared folder and returns its path.

    ``postings`` has (term, doc_id, weight, tf, len), each file sorted by term, so that Parquet's statistics
    leave a search only the row groups and pages of its prefixes; ``stats`` has one row (n, total), ``versions`` the (doc_id, version_id) that was indexed.
    """
    path = new_folder(docs.sparkSession)
    # dealt by hash, for ranges would be sampled, and that would tokenize every text a second time; each file is sorted
    weighed_terms(docs).repartition("term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{path}/postings")
    docs.select("doc_id", "version_id").write.parquet(f"{path}/versions")
    total = docs.sparkSession.read.parquet(f"{path}/postings").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    docs.agg(F.count(F.lit(1)).alias("n")).crossJoin(total).write.parquet(f"{path}/stats")
    return path


def bm25(spark: SparkSession, index: str, terms: Sequence[str]) -> DataFrame:
    """Rows (doc_id, rank) of documents with one of the prefix terms, from a stored index.

    Only postings of the terms are read; they are summed up for each document, and one row of totals is broadcast.
    """
    post = spark.read.parquet(f"{index}/postings")
    has = [(F.col("term") >= t) & (F.col("term") < t + chr(0x10FFFF)) for t in terms]
    rows = post.where(reduce(lambda a, b: a | b, has)).groupBy("doc_id").agg(F.first("len").alias("len"), *(F.sum(F.when(h, F.col("weight")).otherwise(0.0)).alias(f"f{i}") for i, h in enumerate(has)))
    one = rows.agg(*(F.sum(F.when(F.col(f"f{i}") > 0, 1).otherwise(0)).alias(f"n{i}") for i in range(len(terms))))
    stats = spark.read.parquet(f"{index}/stats").crossJoin(F.broadcast(one)).withColumn("avg_len", F.col("total") / F.col("n"))
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.greatest(F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)), F.lit(1e-6))
        f = F.col(f"f{i}")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return rows.crossJoin(F.broadcast(stats)).select("doc_id", score.alias("rank"))  # one row is broadcast


def current_hits(hits: DataFrame, heads: DataFrame) -> DataFrame:
    """Index rows whose version is still the current one of a head."""
    return hits.join(heads, ["query_id", "version_id"])


def lexical_score(query: str, now: Column, named: Column | None = None) -> Column:
    """The rank, squeezed below 1, and bonuses for exact title and table, trust, stars and recency. ``named``: whether a table is the query; else ``tables`` tells."""
    named = F.exists("tables", lambda x: F.lower(x) == query.lower()) if named is None else named
    r = F.abs("rank")
    stars = F.when(F.col("star_count") >= 100, 0.05).when(F.col("star_count") >= 20, 0.035).when(F.col("star_count") >= 5, 0.02).otherwise(0.0)
    recent = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))) / 86_400_000_000 <= 30
    flag = lambda c, v: F.when(c, v).otherwise(0.0)
    return F.least(
        F.lit(1.0),
        r / (1 + r) + flag(F.lower("title") == query.lower(), 0.22) + flag(named, 0.12) + flag(F.col("trusted"), 0.03) + stars + flag(recent, 0.015),
    )


def lexical(heads: DataFrame, docs: DataFrame, index: str, query: str, readable: Column, now: Column, filters: Column | None = None, limit: int = 20) -> DataFrame:
    """Ranked hits of a stored index that the viewer may read; no term, no hit. A document whose current version is not the one that was indexed is none.

    ``docs`` has the texts, ``heads`` what filters and scores need as well. Texts are not carried
    through joins and sorts: the hits, ``limit`` rows, are broadcast to fetch theirs.
    """
    terms = match_terms(query)
    if not terms:
        return heads.limit(0).withColumn("score", F.lit(0.0))
    ranks = bm25(heads.sparkSession, index, terms)
    kept = ["doc_id", "query_id", "version_id", "title", "star_count", "trusted", "updated_at"]
    later = [c for c in docs.columns if c not in kept]  # texts and lists of words: only hits get them
    allowed = heads.where(readable if filters is None else readable & filters)
    is_table = F.exists("tables", lambda x: F.lower(x) == query.lower())
    if "tables" in later:
        named = docs.where(is_table).select("doc_id").distinct().withColumn("_named", F.lit(True))
        narrow = allowed.drop(*later).join(named, "doc_id", "left").withColumn("_named", F.coalesce("_named", F.lit(False)))
    else:
        narrow = allowed.withColumn("_named", F.coalesce(is_table, F.lit(False))).drop(*later)
    indexed = heads.sparkSession.read.parquet(f"{index}/versions").withColumnRenamed("version_id", "_indexed")
    current = narrow.join(ranks.join(indexed, "doc_id"), "doc_id").where(F.col("_indexed") == F.col("version_id")).drop("_indexed")
    rows = current.withColumn("score", lexical_score(query, now, F.col("_named"))).drop("_named")
    order = [F.desc(F.round("score", 9)), F.desc("star_count"), F.desc("updated_at"), F.col("query_id")]
    hits = rows.orderBy(*order).limit(limit)
    return docs.select("doc_id", *later).join(F.broadcast(hits), "doc_id").orderBy(*order)


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two arrays, in double precision."""
    d = lambda c: F.transform(c, lambda x: x.cast("double"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    a, b = d(left), d(right)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(vectors: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """The k nearest by cosine, clamped to 0..1; the query vector is a literal of the plan."""
    q = F.array(*(F.lit(float(x)) for x in query))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col("embedding"), q)))
    return vectors.withColumn("score", score).where("not isnan(score)").orderBy(F.desc(F.round("score", 9)), "vec_id").limit(max(1, min(50, k)))


def hybrid(lexical_rows: DataFrame, semantic: DataFrame, candidates: DataFrame, limit: int = 20) -> DataFrame:
    """Merges lexical hits with authorised semantic ones by query and version.

    Both: 0.62 lexical + 0.38 semantic + 0.06; one alone: its score. A semantic row counts only where a candidate has its version.
    """
    keys = ["query_id", "version_id"]
    cand = candidates.groupBy(*keys).agg(F.min_by("score", "place").alias("sem"))
    lex = lexical_rows.select(*keys, F.col("score").alias("lex"), F.col("star_count").alias("stars_l"))
    auth = semantic.join(cand.select(*keys), keys, "left_semi").select(*keys, F.col("star_count").alias("stars_s"))
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.isnan(c) | c.isNull(), 0.0).otherwise(c)))
    both = lex.join(auth, keys, "full").join(cand, keys, "left")
    l, s = clamp(F.col("lex")), clamp(F.col("sem"))
    mixed = F.col("lex").isNotNull() & F.col("sem").isNotNull()
    score = F.when(mixed, clamp(l * 0.62 + s * 0.38 + 0.06)).when(F.col("lex").isNotNull(), l).otherwise(s)
    kind = F.when(mixed, "hybrid").when(F.col("lex").isNotNull(), "lexical").otherwise("semantic")
    out = both.select(*keys, kind.alias("match_type"), score.alias("score"), F.coalesce("stars_l", "stars_s").alias("star_count"))
    return out.orderBy(F.desc(F.round("score", 9)), F.desc("star_count"), "query_id").limit(limit)


def comparable(text: Column) -> Column:
    """Lower case, with anything but letters, digits and underscores as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}_]+", " "))


def adequacy(results: DataFrame, query: str) -> DataFrame:
    """One row (adequate, confidence, reason) for ranked results with place, title, tables and score."""
    q = comparable(F.lit(query))
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.isnan("score"), 0.0).otherwise(F.col("score"))))
    rows = results.select("place", s.alias("s"), (comparable(F.col("title")) == q).alias("t"), F.exists("tables", lambda x: comparable(x) == q).alias("b"))
    one = rows.agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.when(F.col("t"), F.col("s")), F.when(F.col("t"), F.col("place"))).alias("title"),
        F.min_by(F.when(F.col("b"), F.col("s")), F.when(F.col("b"), F.col("place"))).alias("table"), F.slice(F.reverse(F.sort_array(F.collect_list("s"))), 1, 2).alias("top"),
    )
    first, second = F.coalesce(F.get("top", F.lit(0)), F.lit(0.0)), F.coalesce(F.get("top", F.lit(1)), F.lit(0.0))
    reason = (
        F.when(F.col("n") == 0, "no-results").when(F.col("title").isNotNull(), "exact-title").when(F.col("table").isNotNull(), "exact-table")
        .when(first >= 0.74, "strong-score").when((first >= 0.64) & (first - second >= 0.12), "clear-leading-result").otherwise("weak-score")
    )
    sure = F.when(F.col("n") == 0, 0.0).when(F.col("title").isNotNull(), F.greatest(F.lit(0.96), "title")).when(F.col("table").isNotNull(), F.greatest(F.lit(0.9), "table")).otherwise(first)
    return one.select((~reason.isin("no-results", "weak-score")).alias("adequate"), sure.alias("confidence"), reason.alias("reason"))


def retrieval_mode(results: DataFrame) -> DataFrame:
    """hybrid over semantic over lexical; none without results."""
    has = lambda k: F.coalesce(F.max(F.col("match_type") == k), F.lit(False))
    return results.agg(F.when(has("hybrid"), "hybrid").when(has("semantic"), "semantic").when(has("lexical"), "lexical").otherwise("none").alias("mode"))


def namespaces(viewer: int | None) -> list[str]:
    """What a viewer may search: the public vectors and, signed in, their own."""
    return ["public"] if viewer is None else ["public", f"private:{viewer}"]


def search(heads: DataFrame, docs: DataFrame, index: str, vectors: DataFrame, query: str, viewer_readable: Column, now: Column, embedding: Sequence[float] | None = None, limit: int = 20) -> tuple[DataFrame, dict]:
    """Lexical search; if that is not adequate and there is a query vector, hybrid search.

    ``vectors`` has vec_id (the document), query_id, version_id and embedding, in the viewer's
    namespaces only. Two small actions at most: the assessment, one row, and the results.
    """
    hits = written(lexical(heads, docs, index, query, viewer_readable, now, limit=limit))
    ranked = hits.select("query_id", "version_id", "title", "tables", "score", "star_count", F.row_number().over(_result_order()).alias("place"))
    told = adequacy(ranked, query).first().asDict()
    if told["adequate"] or embedding is None:
        return ranked.withColumn("match_type", F.lit("lexical")), told
    near = top_k(vectors, embedding, max(10, min(50, 2 * limit)))
    near = near.select("query_id", "version_id", "score", F.row_number().over(_result_order("vec_id")).alias("place"))
    allowed = heads.where(viewer_readable).select("query_id", "version_id", "star_count").join(F.broadcast(near.select("query_id")), "query_id", "left_semi")  # 50 rows at most
    merged = hybrid(ranked, allowed, near, limit)
    return merged, told


def _result_order(last: str = "query_id"):
    from pyspark.sql import Window

    return Window.orderBy(F.desc(F.round("score", 9)), last)


def all_terms(text: str, columns: Sequence[str]) -> Column:
    """Every word of the text occurs somewhere in the columns, whatever the case."""
    hay = F.lower(F.concat_ws(" ", *columns))
    out = F.lit(True)
    for word in text.lower().split():
        out = out & F.contains(hay, F.lit(word))
    return out


def terms_of(text: Column) -> Column:
    """The prefix terms of a request as a column: words of two characters or more, the first 16, then distinct."""
    found = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)), lambda w: F.length(w) > 1)
    return F.array_distinct(F.slice(found, 1, 16))


def supporting(hits: DataFrame, most: int = 5) -> DataFrame:
    """What a generated text may lean on: hits that are public, or whose use was acknowledged; the first ``most`` by place."""
    return hits.where((F.col("visibility") == "public") | F.col("acknowledged")).orderBy("place").limit(most)


def generation_gate(adequate: Column, complete: Column, dialect: Column) -> Column:
    """409 where the corpus answers, 503 where retrieval was not whole, 422 without a dialect, else 200."""
    return F.when(adequate, 409).when(~complete, 503).when(dialect.isNull(), 422).otherwise(200)
