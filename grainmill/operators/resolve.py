"""Which known query an imported block is: same text first, then same place, else a new id.

One to one, in the order of blocks, as a block takes the best query that is left: the one in the same place, then those not deleted, then the
nearest. Blocks and queries of one file and one text meet in an equi-join of two short arrays (the repeats of a text in one file) and a
fold over them; places are paired by rank. A file as a whole is never one task's group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.functions import text as t


def resolved_ids(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows (path, block, query_id, how) for ``incoming`` (path, block, new_id, body).

    ``existing`` has path, block, query_id, body, owner_id and deleted; rows with an owner are never taken over. query_id and new_id are unique.
    """
    key = F.sha2(t.normalize_body(F.col("body")), 256).alias("text_key")
    new = incoming.select("path", F.col("block").cast("long").alias("block"), "new_id", key)
    old = existing.where("owner_id is null").select("path", F.col("block").cast("long").alias("block"), "query_id", key, F.coalesce("deleted", F.lit(False)).alias("deleted"))
    by_text = _by_text(new, old)
    new = new.join(by_text.select("new_id"), "new_id", "left_anti")
    old = old.join(by_text.select("query_id"), "query_id", "left_anti")
    nth = lambda *order: F.row_number().over(Window.partitionBy("path", "block").orderBy(*order))
    by_place = new.withColumn("n", nth("new_id")).drop("text_key").join(old.withColumn("n", nth("deleted", "query_id")).drop("text_key"), ["path", "block", "n"])
    left = new.join(by_place.select("new_id"), "new_id", "left_anti")
    row = lambda df, id_, how: df.select("path", "block", F.col(id_).alias("query_id"), F.lit(how).alias("how"))
    return row(by_text, "query_id", "text").unionByName(row(by_place, "query_id", "place")).unionByName(row(left, "new_id", "new"))


def _by_text(new: DataFrame, old: DataFrame) -> DataFrame:
    group = ["path", "text_key"]
    blocks = new.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("block", "new_id"))).alias("blocks"))
    known = old.groupBy(*group).agg(F.collect_list(F.struct("deleted", "block", "query_id")).alias("known"))

    def take(s: Column, b: Column) -> Column:
        rank = lambda o: F.struct((o["block"] != b["block"]).alias("a"), o["deleted"].alias("b"), F.abs(o["block"] - b["block"]).alias("c"), o["block"].alias("d"), o["query_id"].alias("query_id"))
        best = F.array_min(F.transform(s["left"], rank))["query_id"]
        pair = F.struct(b["block"].alias("block"), b["new_id"].alias("new_id"), best.alias("query_id"))
        return F.when(F.size(s["left"]) == 0, s).otherwise(F.struct(F.filter(s["left"], lambda o: o["query_id"] != best).alias("left"), F.concat(s["pairs"], F.array(pair)).alias("pairs")))

    none = F.array().cast("array<struct<block:bigint,new_id:string,query_id:string>>")
    pairs = F.aggregate("blocks", F.struct(F.col("known").alias("left"), none.alias("pairs")), take, lambda s: s["pairs"])
    return blocks.join(known, group).select("path", F.inline(pairs))
