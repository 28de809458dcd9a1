"""Operator 7: sharding by balanced label propagation, with DataFrame functions only.

Law ``bytes``: shard sizes are near equal. Documents of equal text are linked (each to
its group, not to one another), and a link is cut when its ends lie in different shards.

1. Labels start as a hash of the row.
2. In each round the share of every linked group in every shard is summed, and documents
   want to move to the shard that holds most of their group, of those with room if one has (ties go by a hash). Rounds go on
   until no document wants to move or the cut stops falling. Quotas hold: a shard accepts
   movers, by a hash, only with the probability room / bytes on their way to it. A group of
   more than half a shard's quota aims at as many shards as it needs, from one that its hash gives.
3. Last, documents stand in order of label and group, and running sums of bytes cut that
   order into shards of equal size. Documents so large that a cut at one of them would
   show (over 1/64 of a shard; at most 64 a shard) are dealt first, largest first, back
   and forth over the shards, and each shard's share of the order is what then is missing.

Sums run over buckets of bounded size, then over buckets of a label, then over labels, so
no task sees all rows, and a group of a third of all rows is salted over many buckets.

Nulls: a null text has 16 bytes, crc32 null, and no links. Repeated
rows are placed each, spread like any other members of a group. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.common import materialize


def _pick(values: list[float], index: Column) -> Column:
    """The value of a short list (one for each shard) at an index from 0."""
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), index.cast("int") + 1)


def propagate(linked: DataFrame, loads: list[int], quota: float) -> DataFrame:
    """``linked`` (node, grp, size, spread, salts, label and more) with the labels of the smallest cut; loads has the bytes of every shard.

    Rounds go on until no document wants to move, or the cut has not fallen for two rounds.
    Documents meet the home of their group under a salt, so that a large group is spread over many tasks.
    """
    shards = len(loads)
    best, least, waited, step = linked, None, 0, 0
    held = {r["label"]: r["bytes"] for r in linked.groupBy("label").agg(F.sum("size").alias("bytes")).collect()}  # one row a shard
    fixed = [loads[s] - held.get(s, 0) for s in range(shards)]
    while True:
        votes = linked.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n"), F.max("salts").alias("salts"), F.max("spread").alias("spread"))
        # shards with room first, as a full one takes no more; a tie goes by a hash, so no shard draws more than others
        most = F.max_by("label", F.struct(_pick([quota - load for load in loads], F.col("label")) > 0, "n", F.xxhash64("grp", "label")))
        homes = votes.groupBy("grp").agg(F.when(F.max("spread") > 1, F.pmod(F.xxhash64("grp"), F.lit(shards)).cast("int")).otherwise(most).alias("home"), F.max("salts").alias("salts"))
        homes = homes.select("grp", "home", F.explode(F.sequence(F.lit(1).cast("long"), "salts")).alias("salt"))
        salt = F.pmod(F.xxhash64("node", F.lit("home")), F.col("salts")) + 1
        wish = F.pmod(F.col("home") + F.pmod(F.xxhash64("node", F.lit("spread")), F.col("spread")), F.lit(shards)).cast("int")
        wants = materialize(linked.withColumn("salt", salt).join(homes, ["grp", "salt"]).withColumn("wish", wish).drop("home", "salt"))
        flows = wants.groupBy("label", "wish").agg(F.sum("size").alias("bytes")).collect()  # shards x shards rows at most
        cut = sum(r["bytes"] for r in flows if r["label"] != r["wish"])
        if least is None or cut < least:
            best, least, waited = wants.drop("wish"), cut, 0
        else:
            waited += 1
        if not cut or waited == 2:
            return best
        loads, away, come = list(fixed), [0] * shards, [0] * shards
        for r in flows:
            loads[r["label"]] += r["bytes"]
            if r["label"] != r["wish"]:
                away[r["label"]] += r["bytes"]
                come[r["wish"]] += r["bytes"]
        chance = [max(0.0, min(1.0, (quota - loads[s] + away[s] / 2) / come[s])) if come[s] else 0.0 for s in range(shards)]
        draw = F.pmod(F.xxhash64("node", F.lit(f"move {step}")), F.lit(1 << 20)) / float(1 << 20)
        goes = (F.col("label") != F.col("wish")) & (draw < _pick(chance, F.col("wish")))
        linked = wants.withColumn("label", F.when(goes, F.col("wish")).otherwise(F.col("label"))).drop("wish")
        step += 1


def shards_by_bytes(docs: DataFrame, shards: int = 40, bucket_rows: int = 1000) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard)."""
    base = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.encode(F.col("text"), "utf-8")).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.xxhash64(F.col("text"), F.octet_length("text"))).alias("grp"),
    )
    # the row's number parts rows that repeat: it is fixed when the table is written, and they spread over salts and buckets
    base = base.withColumn("node", F.xxhash64("doc_id", "grp", F.monotonically_increasing_id()))
    base = materialize(base.withColumn("label", F.pmod("node", F.lit(shards)).cast("int")))
    by_label = {r["label"]: (r["n"], r["bytes"]) for r in base.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect()}  # one row a shard
    n, total = sum(v[0] for v in by_label.values()), sum(v[1] for v in by_label.values())
    per_shard = max(1.0, total / shards)
    quota = 1.02 * per_shard

    groups = base.where("grp is not null").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).where("n > 1")
    # a table of its own, so that the join shuffles both sides and Spark can split a large group
    groups = materialize(groups.select("grp", F.ceil(F.col("bytes") / (quota / 2)).cast("int").alias("spread"), F.ceil(F.col("n") / bucket_rows).alias("salts")))
    rows = materialize(base.join(groups, "grp", "left"))
    linked = propagate(rows.where("spread is not null"), [by_label.get(s, (0, 0))[1] for s in range(shards)], quota)
    rows = rows.where("spread is null").unionByName(linked)
    spread = max(1, int(n / shards / bucket_rows))
    rows = rows.select(
        "doc_id", "size", "text_crc32", "grp", "node", "label", (F.col("size") > per_shard / 64).alias("big"), F.pmod(F.xxhash64(F.coalesce("grp", "node")), F.lit(spread)).alias("b"),
        F.pmod(F.xxhash64("node", F.lit("salt")), F.coalesce("salts", F.lit(1))).alias("salt"),
    )

    # large documents: 64 a shard at most
    rank = F.row_number().over(Window.orderBy(F.col("size").desc(), "node", "doc_id")) - 1
    turn, place = (rank / shards).cast("int"), rank % shards
    big = rows.where("big").withColumn("shard", F.when(turn % 2 == 0, place).otherwise(shards - 1 - place).cast("int"))
    given = {r["shard"]: r["g"] for r in big.groupBy("shard").agg(F.sum("size").alias("g")).collect()}  # one row a shard
    lack = [max(0.0, per_shard - given.get(s, 0)) for s in range(shards)]
    open_ = [s for s in range(shards) if lack[s] > 0] or [0]
    whole = sum(lack) or 1.0
    ends = [sum(lack[: s + 1]) / whole for s in open_]

    # the others, in order of label, bucket and group
    small = rows.where("not big")
    buckets = small.groupBy("label", "b", "salt").agg(F.sum("size").alias("bytes"))
    buckets = buckets.withColumn("inside", F.sum("bytes").over(Window.partitionBy("label").orderBy("b", "salt")) - F.col("bytes"))
    buckets = materialize(buckets)
    sums = {r["label"]: r["s"] for r in buckets.groupBy("label").agg(F.sum("bytes").alias("s")).collect()}  # one row a shard
    before = [sum(sums.get(t, 0) for t in range(s)) for s in range(shards)]
    every = max(1, sum(sums.values()))
    run = F.sum("size").over(Window.partitionBy("label", "b", "salt").orderBy("grp", "node", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    placed = small.withColumn("run", run).join(buckets.drop("bytes"), ["label", "b", "salt"])
    spot = (_pick(before, F.col("label")) + F.col("inside") + F.col("run") - F.col("size") / 2) / every
    at = F.least(F.size(F.filter(F.array(*map(F.lit, ends)), lambda end: end <= spot)), F.lit(len(open_) - 1))
    placed = placed.withColumn("shard", _pick(open_, at).cast("int"))
    cols = ["doc_id", "size", "text_crc32", "node", "shard"]
    placed = placed.select(*cols).unionByName(big.select(*cols))
    placed = materialize(placed.withColumn("b", F.pmod(F.xxhash64("node", F.lit("slot"), "doc_id"), F.lit(spread))))

    # slots: running numbers over hashed buckets of each shard
    held = placed.groupBy("shard", "b").agg(F.count(F.lit(1)).alias("k"))
    held = held.select("shard", "b", (F.sum("k").over(Window.partitionBy("shard").orderBy("b")) - F.col("k")).alias("base"))
    number = F.row_number().over(Window.partitionBy("shard", "b").orderBy("doc_id", "node"))
    out = placed.withColumn("number", number).join(held, ["shard", "b"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("number") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
