"""Operator 13: resampling documents by their importance for a target distribution.

Features are runs of 1 to ``most`` words, in lower case and joined by a space, in ``buckets`` buckets by crc32. A bucket's gain compares its
smoothed share of all documents with that of the target texts; a document's weight is the
mean of its features' gains. With Gumbel noise from a hash of the id the highest scores are a
sample without replacement by importance.

Words are found, joined and hashed on the bytes of a whole Arrow batch with numpy; gains are one array, indexed by
the bucket array (``buckets`` numbers, whatever the size of the corpus). Counts are summed
a partition at a time before they meet. Ranks come from a distributed radix sort of the rows of numbers (``radix``).

Nulls: a null text has no features and weight 0; a null id hashes as an empty string and stands first in a tie. Rows that agree in
score and id stand in any order. An empty table gives no rows; empty target texts count no feature.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm import radix
from grainmill.llm.common import materialize

#: Bytes of words: digits, letters of a to z (A to Z become these) and all of other scripts.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_IN_WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Features of more bytes are hashed one by one, shorter ones all at once.
LONG_FEATURE = 64
#: Bytes of text that are worked on at once, but for a longer text.
STRETCH = 1 << 22


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crc32_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of many stretches of ``data``: all first bytes, then all second bytes, and so on."""
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-lengths, kind="stable")
    at, size = starts[order], lengths[order]
    out = np.empty(len(starts), np.uint32)
    n_long = int(np.searchsorted(-size, -LONG_FEATURE, "left"))
    for i in range(n_long):
        crc[i] = zlib.crc32(data[at[i] : at[i] + size[i]]) ^ 0xFFFFFFFF
    live = len(starts)
    for k in range(LONG_FEATURE):
        live = int(np.searchsorted(-size, -k, "left"))  # those longer than k
        if live <= n_long:
            break
        part = slice(n_long, live)
        crc[part] = _CRC[(crc[part] ^ data[at[part] + k]) & 0xFF] ^ (crc[part] >> np.uint32(8))
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def features(texts: pa.Array, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, its text, number of words of each text) of a batch of texts."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.binary() else np.int64, len(texts) + 1, texts.offset * (4 if texts.type == pa.binary() else 8)).astype(np.int64)
    base = offsets[0] if len(offsets) else 0
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[base : offsets[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    offsets = offsets - base
    data = _LOWER[raw]
    inside = _IN_WORD[data]
    # a text's first byte begins a word even where the text before ends in one
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    owner = np.searchsorted(offsets, starts, "right") - 1
    n_words = np.bincount(owner, minlength=len(texts))
    # words in a row, one space between, so that a run of words is a stretch of bytes too
    lengths = stops - starts
    spaced = np.cumsum(np.r_[0, lengths + 1])
    packed = np.full(int(spaced[-1]), 32, np.uint8)
    packed[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(starts)), lengths)] = data[inside]
    found, owners = [], []
    for run in range(1, most + 1):
        first = np.flatnonzero(owner[: len(owner) - run + 1] == owner[run - 1 :]) if len(owner) >= run else np.zeros(0, np.int64)
        size = spaced[first + run] - spaced[first] - 1
        found.append(crc32_of(packed, spaced[first], size) % np.uint32(buckets))
        owners.append(owner[first])
    return np.concatenate(found).astype(np.int64), np.concatenate(owners), n_words


def _parts(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The array in slices of about STRETCH bytes, with their first row."""
    width = 4 if texts.type == pa.binary() else 8
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if width == 4 else np.int64, len(texts) + 1, texts.offset * width)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STRETCH, "right")) - 1)
        yield at, texts.slice(at, end - at)
        at = end


def _binary(column: pa.Array) -> pa.Array:
    """Bytes of a text column; nulls are empty."""
    column = column.fill_null("")
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def bucket_counts(texts: DataFrame, most: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; the driver gets ``buckets`` numbers."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, part in _parts(_binary(b.column(0))):
                total += np.bincount(features(part, most, buckets)[0], minlength=buckets)
        yield pa.record_batch({"bucket": np.flatnonzero(total), "n": total[total > 0]})

    rows = texts.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed share in the target over that in the source), by bucket."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    n = float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _noise(id_: Column, seed: str) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000, seed: str = "2024") -> DataFrame:
    """Rows (doc_id, n_features, n_words, weight, score), one for each document."""
    gain = gains(bucket_counts(docs, most, buckets), bucket_counts(target, most, buckets))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in _parts(_binary(b.column("text"))):
                bucket, owner, n_words = features(part, most, buckets)
                n = np.bincount(owner, minlength=len(part))
                order = np.argsort(owner, kind="stable") if most > 1 else slice(None)
                run = np.r_[0, np.cumsum(gain[bucket[order]])]
                ends = np.cumsum(n)
                total = run[ends] - run[ends - n]
                yield pa.record_batch({"doc_id": b.column("doc_id").slice(at, len(part)), "n_features": n, "n_words": n_words, "weight": total // np.maximum(n, 1)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(weighed, f"doc_id {kind}, n_features long, n_words long, weight long")
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, most: int = 1, buckets: int = 10_000, seed: str = "2024") -> DataFrame:
    """Rows (doc_id, n_features, weight, score, rank), one for each document; rank is null for those not drawn.

    floor(percent * N / 100) documents are drawn, of the N with at least ``least_words`` words.
    """
    rows = materialize(scored(docs, target, most, buckets, seed))
    long_enough = rows.where(F.col("n_words") >= least_words)
    drawn = long_enough.count() * percent // 100
    ranks = radix.ranked(long_enough, [radix.Key("score", descending=True), radix.Key("doc_id")])
    out = ["doc_id", "n_features", "weight", "score"]
    return ranks.select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).unionByName(rows.where(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank")))
