"""Global ranks by a distributed LSD radix sort: stable counting-sort passes over digits of a composite key.

Rows have a place from 0, in blocks of bounded size. A pass orders each block's rows by their place within
the digit, counts (digit, block), turns the counts into global offsets (sums over digits,
then over the blocks of a digit), and so gives every row its next place: offset of its digit and block, plus its
rank there. As each pass is stable, the places after the last, most significant digit are ranks. Blocks are cut by place, so a value
that a third of all rows share fills blocks like any other; no range of keys has to be guessed.

Each pass is written to the shared folder, and the one before is deleted. Digits that all rows share are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.common import remove, shared_dir

#: Bits of a digit at most: 2048 counts a block.
DIGIT_BITS = 11
#: Rows of a block: what a task orders at once.
BLOCK_ROWS = 1 << 16

_SIGN = -(1 << 63)


@dataclass(frozen=True)
class Key:
    """A long column of the composite key. Nulls stand first, whatever the direction."""

    name: str
    descending: bool = False


def _spans(rows: DataFrame, keys: list[Key]) -> list[tuple[int, bool]]:
    """Of each key, the number of low bits in which values differ, and whether it has nulls; one row of minima and maxima."""
    found = rows.agg(*(f(k.name).alias(f"{f.__name__}{i}") for i, k in enumerate(keys) for f in (F.min, F.max)), *(F.count_if(F.col(k.name).isNull()).alias(f"nulls{i}") for i, k in enumerate(keys))).first()
    low = lambda i: found[f"min{i}"] or 0
    return [(((low(i) ^ (found[f"max{i}"] or 0)) & (1 << 64) - 1).bit_length(), found[f"nulls{i}"] > 0) for i in range(len(keys))]


def digits(rows: DataFrame, keys: list[Key], bits: int = DIGIT_BITS) -> list[Column]:
    """The digits of the composite key, least significant first."""
    out = []
    for key, (width, nulls) in zip(reversed(keys), reversed(_spans(rows, keys)), strict=True):
        value = F.coalesce(F.col(key.name), F.lit(0).cast("long")).bitwiseXOR(F.lit(_SIGN))
        value = F.bitwise_not(value) if key.descending else value
        for at in range(0, width, bits):
            out.append(F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << min(bits, width - at)) - 1)).cast("int"))
        if nulls:
            out.append(F.when(F.col(key.name).isNull(), 0).otherwise(1))
    return out


def ranked(rows: DataFrame, keys: list[Key], rank: str = "rank", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with their rank from 1 in the order of ``keys``; rows that agree in all keys stand in any order.

    ``rows`` must be cheap to read twice (a written table). Its columns must not be named place, block, digit, inside or offset.
    """
    spark = rows.sparkSession

    def stored(df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    # one pass at least, which makes places dense
    path, placed = None, None
    for digit in digits(rows, keys) or [F.lit(0)]:
        if placed is None:  # any order will do at first; it is written with the first pass and fixed from then on
            path = shared_dir(spark)
            placed = stored(rows.withColumn("place", F.monotonically_increasing_id()), path)
        next_path = shared_dir(spark)
        placed = stored(_counted(placed, digit, block_rows).select(*rows.columns, "place"), next_path)
        remove(spark, path)
        path = next_path
    return placed.select(*rows.columns, (F.col("place") + 1).alias(rank))


def _counted(placed: DataFrame, digit: Column, block_rows: int) -> DataFrame:
    """One pass: the rows with their next place."""
    rows = placed.withColumn("block", F.floor(F.col("place") / block_rows)).withColumn("digit", digit)
    inside = rows.withColumn("inside", F.row_number().over(Window.partitionBy("block", "digit").orderBy("place")) - 1)
    counts = rows.groupBy("block", "digit").agg(F.count(F.lit(1)).alias("n"))
    # 2048 rows at most in the first window, a row a block in the other
    firsts = counts.groupBy("digit").agg(F.sum("n").alias("n"))
    firsts = firsts.select("digit", (F.sum("n").over(Window.orderBy("digit")) - F.col("n")).alias("first"))
    before = F.sum("n").over(Window.partitionBy("digit").orderBy("block")) - F.col("n")
    offsets = counts.withColumn("before", before).join(firsts, "digit").select("block", "digit", (F.col("first") + F.col("before")).alias("offset"))
    return inside.join(offsets, ["block", "digit"]).withColumn("place", (F.col("offset") + F.col("inside")).cast("long"))
