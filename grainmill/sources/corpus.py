"""The corpus model over the driver's tables: heads with their current version, stars, reports, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dialect of each document language; fixed values.
DIALECTS = {"en": "sentinel", "fr": "defender-xdr", "de": "azure-data-explorer", "es": "azure-resource-graph"}

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores where a small table is fewer splits than there are cores; larger tables are left as they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version columns from the documents alone; no join, so only the columns in use are read."""
    d = spread(read(spark, sf_dir, "documents"))
    first = F.substring_index("text", "\n", 1)
    low = F.lower("text")
    dialect = F.coalesce(*(F.when(F.col("lang") == k, F.lit(v)) for k, v in DIALECTS.items()))
    words = lambda p: F.sort_array(F.array_distinct(F.regexp_extract_all(low, F.lit(p), F.lit(0))))
    rows = d.select(
        F.col("doc_id"),
        F.col("doc_id").cast("string").alias("query_id"),
        F.concat(F.col("doc_id").cast("string"), F.lit("-v1")).alias("version_id"),
        F.trim(F.substring(first, 1, 180)).alias("title"),
        F.col("text").alias("kql"),
        F.substr("text", F.length(first) + 2).alias("description"),
        dialect.alias("dialect"),
        words("[a-z]{8,}").alias("tables"),
        words("[a-z]{6,7}").alias("operators"),
        F.col("source").alias("repository"),
        (F.col("doc_id") % 150).alias("owner_id"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("updated_at"),
    )
    tags = F.filter("tables", lambda w: F.length(w) >= 10).alias("tags")  # runs of 10 letters or more are among those of 8, so the text is searched once for both
    at = rows.columns.index("repository")
    return rows.select(*rows.columns[:at], tags, *rows.columns[at:])


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (user_id, doc_id) pairs; starring twice counts once."""
    n = read(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))
    clicks = read(spark, sf_dir, "events").where("event_type = 'click'")
    return clicks.crossJoin(F.broadcast(n)).select("user_id", (F.col("event_id") % F.col("n")).alias("doc_id")).distinct()


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))
    errors = read(spark, sf_dir, "events").where("event_type = 'error'")
    return errors.crossJoin(F.broadcast(n)).select("event_id", "user_id", "ts", (F.col("event_id") % F.col("n")).alias("doc_id"))


def labelled(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds visibility, moderation status, deletion and trust."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    size = F.col("_size")  # measured before the join, so that texts nobody asks for are not shuffled
    return docs.withColumn("_size", F.length("kql")).join(labels, "doc_id", "left").select(
        *docs.columns, F.when(F.col("toxic") == 1, "private").otherwise("public").alias("visibility"),
        F.when((F.col("quality") == 0) & (size % 5 == 0), "unpublished").otherwise("visible").alias("moderation_status"),
        F.coalesce(size % 23 == 0, F.lit(False)).alias("deleted"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("trusted"),
    )


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current versions with visibility, trust and star count."""
    count = stars(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("star_count"))
    base = labelled(documents(spark, sf_dir), spark, sf_dir)
    return base.join(count, "doc_id", "left").withColumn("star_count", F.coalesce("star_count", F.lit(0).cast("long")))


#: The same projection in SQL, as common table expressions.
SQL = """
n_docs AS (SELECT count(*) AS n FROM documents),
star_rows AS (SELECT DISTINCT user_id, event_id % n AS doc_id FROM events, n_docs WHERE event_type = 'click'),
report_rows AS (SELECT event_id, user_id, ts, event_id % n AS doc_id FROM events, n_docs WHERE event_type = 'error'),
star_counts AS (SELECT doc_id, count(*) AS star_count FROM star_rows GROUP BY doc_id),
corpus AS (
  SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS query_id, CAST(d.doc_id AS VARCHAR) || '-v1' AS version_id,
    trim(substr(split_part(text, chr(10), 1), 1, 180)) AS title, text AS kql,
    substr(text, length(split_part(text, chr(10), 1)) + 2) AS description,
    CASE lang WHEN 'en' THEN 'sentinel' WHEN 'fr' THEN 'defender-xdr' WHEN 'de' THEN 'azure-data-explorer' WHEN 'es' THEN 'azure-resource-graph' END AS dialect,
    list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{8,}'))) AS tables,
    list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{6,7}'))) AS operators,
    list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{10,}'))) AS tags,
    source AS repository, d.doc_id % 150 AS owner_id,
    TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) AS updated_at,
    CASE WHEN toxic = 1 THEN 'private' ELSE 'public' END AS visibility,
    CASE WHEN quality = 0 AND length(text) % 5 = 0 THEN 'unpublished' ELSE 'visible' END AS moderation_status,
    coalesce(length(text) % 23 = 0, false) AS deleted,
    coalesce(quality = 1, false) AS trusted,
    coalesce(star_count, 0) AS star_count
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN star_counts s ON d.doc_id = s.doc_id
)
"""

#: Who may read what, in SQL; {c} is a table alias with its dot, or nothing.
SQL_PUBLIC = "({c}visibility = 'public' AND {c}moderation_status = 'visible' AND NOT {c}deleted)"
SQL_READABLE = "(NOT {c}deleted AND (({c}visibility = 'public' AND {c}moderation_status = 'visible') OR {c}owner_id = {viewer}))"

SQL_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
