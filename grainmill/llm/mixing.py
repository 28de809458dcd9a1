"""Operator 9: mixing sources to target weights, with DataFrame functions only.

A document's size is its number of words. Sources in code point order, null last,
weigh 1, 2, 3, 1, 2, 3, ...; each one's target is its share of all words by weight, at
most ``most`` times its own words, and what is cut off is shared again by weight among
those below. Filled up like this, a target is min(most * own, level * weight) with one
level for all, which is found without a loop: in ascending order of most * own /
weight the sources at their limit come first.

A document is emitted floor(rate) times, rate = target / own words of its source, and
once more when a hash of its id, as a number in [0, 1), lies below the rest of the rate.
The result depends on the rows alone, not on partitions or order.

Nulls: a null text has size 0; null sources are one source of their own; a null id
hashes as an empty string. Repeated rows are decided alike. A source without words
has target 0. An empty table gives no rows. One row per source passes a single task;
documents never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.common import materialize

#: Sources up to this number are broadcast (some 50 bytes each); above, the join shuffles.
BROADCAST_SOURCES = 10_000


def words(text: Column) -> Column:
    """Number of words, that is of runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, most: float = 3.0) -> DataFrame:
    """Rows (source, source_size, target) from rows with source and size."""
    own = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = own.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    by = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    limited = (
        ranked.withColumn("total", F.sum("source_size").over(every))
        .withColumn("own_before", F.sum("source_size").over(by) - F.col("source_size"))
        .withColumn("weight_left", F.sum("weight").over(every) - F.sum("weight").over(by) + F.col("weight"))
        .withColumn("level", (F.col("total") - most * F.col("own_before")) / F.col("weight_left"))
        .withColumn("free", F.col("level") * F.col("weight") < most * F.col("source_size"))
        .withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("own_before"), F.col("level")))).over(every)["level"])
    )
    full = most * F.col("source_size")
    return limited.select("source", "source_size", F.when(F.col("level").isNull(), full).otherwise(F.least(full, F.col("level") * F.col("weight"))).alias("target"))


def copies(id_: Column, rate: Column, seed: str = "") -> Column:
    """floor(rate), and one more with probability equal to the fraction."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(id_.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix_plan(docs: DataFrame, most: float = 3.0, seed: str = "") -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, n_copies), one for each document."""
    sized = materialize(docs.select("doc_id", "source", words(F.col("text")).alias("size")))
    wanted = materialize(targets(sized, most))
    return _with_rate(sized, wanted, most, seed).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"), "n_copies")


def _with_rate(sized: DataFrame, wanted: DataFrame, most: float, seed: str) -> DataFrame:
    right = wanted.withColumnRenamed("source", "source_")
    if wanted.count() <= BROADCAST_SOURCES:
        right = F.broadcast(right)
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    return sized.join(right, F.col("source").eqNullSafe(F.col("source_"))).withColumn("n_copies", copies(F.col("doc_id"), rate, seed))


def mixed(docs: DataFrame, most: float = 3.0, seed: str = "") -> DataFrame:
    """The mix itself: every document as often as the plan takes it, with the columns of ``docs``.

    Whole rows travel in a struct, so columns of any name may come along.
    """
    wanted = materialize(targets(docs.select("source", words(F.col("text")).alias("size")), most))
    rows = docs.select("doc_id", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    planned = _with_rate(rows, wanted, most, seed)
    once = F.array_repeat(F.lit(True), F.col("n_copies").cast("int"))
    return planned.where("n_copies > 0").select("row", F.explode(once)).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
