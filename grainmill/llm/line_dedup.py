"""Operator 11: lines that many documents share, with DataFrame functions only.

A document's text is split at line feeds. A line's key is the line without ASCII white space at
its ends, with A-Z in lower case. Lines are exploded and hashed; distinct documents are counted for each
hash, and a key of at least ``least_chars`` code points that at least ``least_docs`` documents hold goes
everywhere but in the document with the largest id that holds it. What stays is put together again by position.

Only hashes (128 bits), ids and positions are shuffled. Pairs of hash and document are made distinct first
and then summed within their partitions, so a line of a third of all documents is a row a task in the count;
the lines meet the frequent hashes in a plain join, which Spark can split or, by the size of the written
table, broadcast. Texts are shuffled once at most, to meet their positions: not at all where the
positions to drop take less than ``BROADCAST_BYTES``.

Nulls: a null or empty text is one empty line. A null id is an id of its own, below all others. Rows that
repeat an id are one document in the count, and each is returned. An empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import materialize

#: Positions to drop of up to so many bytes are broadcast (their table's size is known by then); above, the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Bytes of a position with its share of the row, on the safe side.
POSITION_BYTES = 16


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    # lower() is as good and faster where no other letters are
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _same_row(left: str, right: str) -> Column:
    return F.col(f"{left}.id").eqNullSafe(F.col(f"{right}.id")) & (F.col(f"{left}.text_hash") == F.col(f"{right}.text_hash"))


def dropped_positions(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """Rows (id, text_hash, at): the positions of the lines to drop, for each document and text that has any."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= least_chars)
    # hashes are read twice, texts are not
    lines = materialize(lines.select("id", "text_hash", "pos", F.unhex(F.md5("key")).alias("h")))
    held = lines.select("h", "id").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    frequent = materialize(held.where(F.col("n") >= least_docs).select("h", "last"))
    gone = lines.join(frequent, "h").where(~F.col("id").eqNullSafe(F.col("last")))
    return gone.groupBy("id", "text_hash").agg(F.collect_set("pos").alias("at"))  # at most the lines of one text


def without_shared_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """Rows (doc_id, text, n_lines, n_dropped, row): the text that stays; row holds all columns as they came."""
    gone = materialize(dropped_positions(docs, least_chars, least_docs))
    size = gone.agg(F.coalesce(F.sum(F.size("at") * POSITION_BYTES + 64), F.lit(0))).first()[0]
    right = F.broadcast(gone) if size <= BROADCAST_BYTES else gone
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), text.alias("whole"), F.xxhash64(text).alias("text_hash"))
    lines = F.split("whole", "\n", -1)
    # hashed sets of positions, so the work is linear in the lines however many go
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("at"))
    kept = F.when(F.col("at").isNull(), F.col("whole")).otherwise(F.array_join(F.transform(stay, lambda p: F.get(lines, p)), "\n"))
    joined = rows.alias("l").join(right.alias("r"), _same_row("l", "r"), "left").select("row", F.col("l.id").alias("doc_id"), "whole", "at")
    return joined.select("doc_id", kept.alias("text"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("at"), F.lit(0)).cast("long").alias("n_dropped"), "row")


def line_digests(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """Rows (doc_id, n_lines, n_dropped, kept_sha256), one for each document."""
    kept = without_shared_lines(docs, least_chars, least_docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))
