"""The change log as a stream: jobs in, vector changes out, and the vectors that follow from them.

The sink only appends: each micro-batch writes its changes to a folder of its own and overwrites
it when the batch is replayed, so a retry changes nothing. The vectors are the
latest change of each vector id; deletes of a batch come before its upserts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.operators import state
from grainmill.sources import corpus
from grainmill.sources.scratch import new_folder

JOB = T.StructType([
    T.StructField("job_id", T.LongType()), T.StructField("query_id", T.StringType()), T.StructField("version_id", T.StringType()), T.StructField("operation", T.StringType()),
    T.StructField("namespace_kind", T.StringType()), T.StructField("owner_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
])
CHANGE = "batch long, job_id long, vector_id string, query_id string, version_id string, namespace string, action string"


def changes(jobs: DataFrame, heads: DataFrame) -> DataFrame:
    """What each job does to the index; stale jobs become deletes of exactly their vector."""
    space = state.namespace(F.col("namespace_kind"), F.col("owner_id"))
    return state.prepared(jobs, heads).select("job_id", state.vector_id(space, F.col("version_id")).alias("vector_id"), "query_id", "version_id", space.alias("namespace"), "action")


def start(jobs: DataFrame, heads: DataFrame, out: str, checkpoint: str):
    """Starts the stream; it ends when the jobs that exist are done."""

    def sink(batch: DataFrame, number: int) -> None:
        rows = changes(batch, heads).withColumn("batch", F.lit(number).cast("long"))
        rows.select(*(c.split()[0] for c in CHANGE.split(", "))).write.mode("overwrite").parquet(f"{out}/b{number:012d}")

    return jobs.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def vectors(spark: SparkSession, out: str) -> DataFrame:
    """The index after all changes so far."""
    rows = spark.read.schema(CHANGE).option("recursiveFileLookup", True).parquet(out)
    order = F.struct("batch", (F.col("action") == "upsert").cast("int").alias("late"), "job_id")
    last = rows.groupBy("vector_id").agg(F.max_by(F.struct("query_id", "version_id", "namespace", "action"), order).alias("c"))
    return last.select("vector_id", "c.*").where("action = 'upsert'").drop("action")


def replay(spark: SparkSession, sf_dir: str, files: int = 4) -> DataFrame:
    """Streams one upsert for each click on a document, in order of the events, and returns the index."""
    folder = new_folder(spark)
    heads = corpus.labelled(corpus.documents(spark, sf_dir), spark, sf_dir)
    n = F.broadcast(heads.agg(F.count(F.lit(1)).alias("n")))
    clicks = corpus.read(spark, sf_dir, "events").where("event_type = 'click'").crossJoin(n).select("event_id", "ts", (F.col("event_id") % F.col("n")).alias("doc_id"))
    known = heads.select("doc_id", "query_id", "visibility", "owner_id", F.when(F.col("doc_id") % 6 == 0, F.concat("query_id", F.lit("-v0"))).otherwise(F.col("version_id")).alias("version_id"))
    kind = F.when(F.col("visibility") == "public", "public").otherwise("private")
    jobs = clicks.join(known, "doc_id").select(F.col("event_id").alias("job_id"), "query_id", "version_id", F.lit("upsert").alias("operation"), kind.alias("namespace_kind"), F.when(kind == "private", F.col("owner_id")).alias("owner_id"), "ts")
    jobs.repartitionByRange(files, "ts").write.parquet(f"{folder}/jobs")
    source = spark.readStream.schema(JOB).option("maxFilesPerTrigger", 1).parquet(f"{folder}/jobs")
    start(source, heads, f"{folder}/changes", f"{folder}/checkpoint").awaitTermination()
    return vectors(spark, f"{folder}/changes")
