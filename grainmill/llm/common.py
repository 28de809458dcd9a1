"""Shared helpers of the llm operators: tables, shared scratch space, components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.sources.scratch import new_folder as shared_dir
from grainmill.sources.scratch import cleared, remove  # noqa: F401
from grainmill.sources.scratch import written as materialize

#: Range of ``drawn``: fine enough for any number of rows a table can have.
DRAWS = 1 << 62


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def drawn(key: list[Column], seed: str, share: float) -> Column:
    """True for about ``share`` of all keys, by a hash; at least one chance in DRAWS, however small the share."""
    draw = F.xxhash64(*key, F.lit(seed)).bitwiseAND(F.lit(DRAWS - 1))
    return draw < F.lit(max(1, min(DRAWS, int(DRAWS * share))))


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs run inside the block hand at most ``most`` rows at once to Python: whole texts of Spark's usual 10,000 rows weigh tens of MB on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph, as rows (id, component).

    ``edges`` has the long columns a and b. component is the smallest id that
    can be reached; ids without an edge to another id have no row. Every round
    takes the smallest label among the neighbours and then follows labels one
    step, so that long chains need few rounds; each round is written to the
    shared folder, and the one before is deleted. Joins and minima only: no group is gathered in
    one task. A graph that has not settled after ``max_rounds`` rounds raises an error; nothing is cut off.
    """
    spark = edges.sparkSession
    paths = [shared_dir(spark) for _ in range(2)]

    def stored(df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a"))
    both = stored(both.distinct(), paths[0])
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")).withColumnRenamed("a", "id"), paths[1])
    for _ in range(max_rounds):
        near = (
            both.join(labels.select(F.col("id").alias("b"), F.col("l").alias("lb")), "b")
            .groupBy("a").agg(F.min("lb").alias("near"))
        )
        taken = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("l").alias("old"), F.least("l", "near").alias("l"))
        parent = labels.select(F.col("id").alias("l"), F.col("l").alias("up"))
        paths.append(shared_dir(spark))
        moved = stored(taken.join(parent, "l", "left").select("id", "old", F.least(F.col("l"), F.coalesce("up", "l")).alias("l")), paths[-1])
        remove(spark, paths.pop(1))
        labels = moved.select("id", "l")
        if moved.where("l <> old").isEmpty():
            remove(spark, paths[0])
            return labels.withColumnRenamed("l", "component")
    raise RuntimeError("components did not settle; raise max_rounds")
