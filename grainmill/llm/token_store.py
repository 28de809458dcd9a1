"""Operator 2: token ids written by grammar compression (Re-Pair) and read back.

Format. A store is a Parquet folder with a row for each shard:
  part, seq     order of the shards: parts follow the documents' order
  n_docs, n_ids documents and ids in the shard
  low, high     smallest and largest document id (null where all are null): Parquet's statistics prune shards by them
  doc_ids       the documents' ids (null allowed), as array
  symbols       the shard's compressed sequence, little-endian uint32
  doc_symbols   number of symbols of each document, uint32
  rules         two uint32 for each nonterminal: what it stands for
  lengths       number of ids of each nonterminal's expansion, uint32
Symbols below ``first_rule`` are ids, the others are nonterminals. No symbol spans
two documents, so a document is decoded from its own symbols alone, and the
lengths tell where an id lies without expanding what comes before it.

Compression follows Re-Pair (Larsson and Moffat) in rounds: each round counts the
pairs of a shard in a hash table, and replaces occurrences that do not overlap, those of the more frequent
pairs first, wherever a rule is used often enough to pay. Rounds go on until an exact count finds no
pair that occurs ``LEAST`` times; neither rounds nor rules are limited.

Nulls: a null text is empty (the end id alone). Null ids come first. Repeated rows
are stored each. Order among equal ids is that of their texts. An empty table
gives an empty store.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.common import shared_dir
from grainmill.llm.library_tokens import piece_table
from grainmill.llm.pieces import frugal, in_batches

STORE = (
    "part int, seq int, first_rule int, n_docs int, n_ids bigint, low bigint, high bigint, doc_ids array<bigint>, symbols binary, "
    "doc_symbols binary, rules binary, lengths binary"
)
#: A pair that occurs this often becomes a rule; one that is used less often than USES would cost more than it saves.
LEAST, USES = 8, 4


def _counted(key: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts pairs in a hash table whose slots hold one pair each, with another hash function each step.

    Gives each place's slot, whether the slot holds the place's pair, and for each slot its pair and count.
    """
    bits = int(np.clip(np.log2(len(key)) + 1, 8, 17))
    slot = ((key * np.uint64((0x9E3779B97F4A7C15 * (2 * step + 1)) % 2**64)) >> np.uint64(64 - bits)).view(np.int64)
    holder = np.zeros(1 << bits, np.uint64)
    holder[slot] = key
    own = holder[slot] == key
    return slot, own, holder, np.bincount(slot[own], minlength=1 << bits)


def _apart(place: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Which of the places, in order, to replace: those that outweigh both neighbours, and every second one of a run of one pair (a a a a)."""
    beside = np.diff(place) == 1
    left, right = np.append(0, np.where(beside, w[:-1], 0)), np.append(np.where(beside, w[1:], 0), 0)
    begin = left != w
    run = np.cumsum(begin) - 1
    first = np.flatnonzero(begin)
    return ((np.arange(len(w)) - first[run]) % 2 == 0) & (w[first] > left[first])[run] & (w >= right)


def compress(ids: np.ndarray, n: np.ndarray, first_rule: int, least: int = LEAST, uses: int = USES):
    """Re-Pair in rounds. Returns symbols, symbols of each document, rules and expansion lengths.

    A pair that was counted and is rare stays rare, so a round counts only pairs with a new symbol and those
    that had no slot yet; when none is left, no pair is frequent.
    """
    sym = ids.astype(np.uint32)
    last = np.zeros(len(sym), bool)  # the last symbol of a document
    last[np.cumsum(n)[n > 0] - 1] = True
    open_ = ~last  # places whose pair may be frequent
    rules, lengths, following, step = [], np.ones(first_rule, np.uint32), first_rule, 0
    while len(at := np.flatnonzero(open_)):
        key = (sym[at].astype(np.uint64) << np.uint64(32)) | sym[at + 1]
        slot, own, holder, count = _counted(key, step)
        step += 1
        open_[at[own & (count[slot] < least)]] = False
        top = np.flatnonzero(count >= least)
        if not len(top):
            continue
        top = top[np.argsort(count[top], kind="stable")]
        weight = np.zeros(len(count), np.int32)
        weight[top] = np.arange(1, len(top) + 1)
        w = weight[slot] * own
        place, w = at[w > 0], w[w > 0]
        hit = _apart(place, w)
        place, w = place[hit], w[hit] - 1
        many = np.bincount(w, minlength=len(top))
        keep = many >= uses
        keep[np.argmax(many)] = True  # a round makes one rule at least, so rounds end
        place, w, pair = place[keep[w]], w[keep[w]], holder[top[keep]]
        a, b = (pair >> np.uint64(32)).astype(np.uint32), (pair & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        lengths = np.concatenate([lengths, lengths[a] + lengths[b]])
        rules.append(np.stack([a, b], 1))
        sym[place] = following + (np.cumsum(keep) - 1)[w].astype(np.uint32)
        following += len(pair)
        last[place] = last[place + 1]
        stay = np.ones(len(sym), bool)
        stay[place + 1] = False
        sym, last, open_ = sym[stay], last[stay], open_[stay]
        new = place - np.arange(len(place))
        for i in (new, np.maximum(new - 1, 0)):
            open_[i] = ~last[i]
    flat = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    per_doc = np.zeros(len(n), np.uint32)
    per_doc[n > 0] = np.diff(np.append(-1, np.flatnonzero(last)))
    return sym, per_doc, flat, lengths[first_rule:]


def decompress(sym: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first_rule: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids that the symbols stand for, and how many each symbol stands for."""
    width = np.ones(first_rule + len(lengths), np.int64)
    width[first_rule:] = lengths
    start = np.concatenate([[0], np.cumsum(width[first_rule:])]).astype(np.int64)
    table = np.zeros(start[-1], np.uint32)
    for lo in _levels(rules, first_rule):
        for side in (0, 1):
            child = rules[lo, side].astype(np.int64)
            into = start[lo] + (0 if side == 0 else width[rules[lo, 0]])
            plain = child < first_rule
            table[into[plain]] = child[plain]
            nested = np.flatnonzero(~plain)
            if len(nested):
                w = width[child[nested]]
                step = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
                table[np.repeat(into[nested], w) + step] = table[np.repeat(start[child[nested] - first_rule], w) + step]
    w = width[sym]
    if not len(sym):
        return np.zeros(0, np.uint32), w
    begin = np.cumsum(w) - w
    flat = np.repeat(np.where(sym < first_rule, 0, start[np.maximum(sym.astype(np.int64) - first_rule, 0)]) - begin, w) + np.arange(w.sum())
    out = np.repeat(sym, w)
    deep = out >= first_rule
    out[deep] = table[flat[deep]]
    return out, w


def _levels(rules: np.ndarray, first_rule: int) -> list[np.ndarray]:
    """Rules by depth, those of ids alone first."""
    depth = np.zeros(first_rule + len(rules), np.int32)
    while True:
        now = depth[rules].max(1) + 1 if len(rules) else np.zeros(0, np.int32)
        if (now == depth[first_rule:]).all():
            return [np.flatnonzero(now == d) for d in range(1, now.max() + 1)] if len(rules) else []
        depth[first_rule:] = now


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, shard_ids: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes all texts and writes the store, in ascending order of ids."""
    first_rule = 1 << 17

    def run(batches):
        table, part, seq = piece_table(tokenizer_path), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, list]] = []
        size = 0

        def shard():
            nonlocal held, size, seq
            ids, n = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            sym, doc_symbols, rules, lengths = compress(ids, n, first_rule)
            docs_ = [d for h in held for d in h[2]]
            known = [d for d in docs_ if d is not None]
            row = {
                "part": part, "seq": seq, "first_rule": first_rule, "n_docs": len(n), "n_ids": len(ids), "doc_ids": docs_, "low": min(known, default=None), "high": max(known, default=None),
                "symbols": sym.astype("<u4").tobytes(), "doc_symbols": doc_symbols.astype("<u4").tobytes(),
                "rules": rules.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(),
            }
            held, size, seq = [], 0, seq + 1
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            texts = [b or b"" for b in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, z in in_batches(texts, min(2_000_000, 2 * shard_ids)):
                ids, n = table.ids(texts[a:z])
                ids = np.insert(ids, np.cumsum(n), end_id)
                held.append((ids, n + 1, doc_ids[a:z]))
                size += len(ids)
                if size >= shard_ids:
                    yield shard()
        if held:
            yield shard()

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(frugal(run, piece_table), STORE).write.option("compression", "zstd").parquet(path)


_ARROW = pa.schema([
    ("part", pa.int32()), ("seq", pa.int32()), ("first_rule", pa.int32()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("symbols", pa.binary()), ("doc_symbols", pa.binary()), ("rules", pa.binary()), ("lengths", pa.binary()),
])


def read_store(spark, path: str, with_ids: bool = True) -> DataFrame:
    """Rows (part, seq, place, doc_id, at, n_tokens, ids_crc32[, ids]) of a store; at counts from the shard's start."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sym = np.frombuffer(row["symbols"], "<u4")
                rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
                ids, width = decompress(sym, rules, np.frombuffer(row["lengths"], "<u4"), row["first_rule"])
                upto = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(np.frombuffer(row["doc_symbols"], "<u4").astype(np.int64))])]
                raw = memoryview(ids.astype("<u4").tobytes())
                cols = [
                    pa.array(np.full(row["n_docs"], row["part"], np.int32)), pa.array(np.full(row["n_docs"], row["seq"], np.int32)),
                    pa.array(np.arange(row["n_docs"], dtype=np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(upto[:-1]), pa.array(np.diff(upto)),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())], pa.int64()),
                ]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = "part int, seq int, place int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    names = [c.split()[0] for c in kind.split(", ")]
    return spark.read.schema(STORE).parquet(path).mapInArrow(frugal(run), kind)


def read_ids(spark, path: str, wanted: Sequence[int], start: int = 0, length: int | None = None) -> DataFrame:
    """Rows (doc_id, ids) of some documents, or of the ids from ``start`` on, ``length`` of them at most.

    Shards that hold none of the documents are skipped by their statistics. In a shard, expansion lengths tell which symbols cover
    the range; only those are expanded.
    """
    wanted = sorted(set(wanted))
    if not wanted:
        return spark.createDataFrame([], "doc_id bigint, ids array<int>")

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                rules, lengths = np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["lengths"], "<u4")
                width = np.concatenate([np.ones(row["first_rule"], np.int64), lengths])
                upto = np.concatenate([[0], np.cumsum(np.frombuffer(row["doc_symbols"], "<u4").astype(np.int64))])
                for i, d in enumerate(row["doc_ids"]):
                    if d in wanted:
                        sym = np.frombuffer(row["symbols"], "<u4")[upto[i] : upto[i + 1]]
                        stop = np.cumsum(width[sym])
                        end = int(stop[-1]) if length is None else min(int(stop[-1]), start + length)
                        a, z = np.searchsorted(stop, start, "right"), np.searchsorted(stop, end) + 1
                        got = expanded(sym[a:z], rules, row["first_rule"]) if end > start else []
                        skip = start - int(stop[a - 1]) if a and end > start else start
                        out.append({"doc_id": d, "ids": got[skip : skip + max(0, end - start)]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    near = (F.col("high") >= wanted[0]) & (F.col("low") <= wanted[-1])
    here = F.arrays_overlap("doc_ids", F.array(*map(F.lit, wanted)))
    return spark.read.schema(STORE).parquet(path).where(near & here).mapInArrow(frugal(run), "doc_id bigint, ids array<int>")


def expanded(symbols: np.ndarray, rules: np.ndarray, first_rule: int) -> list[int]:
    """The ids of a few symbols, without expanding any other rule."""
    out, todo = [], symbols[::-1].tolist()
    while todo:
        s = todo.pop()
        if s < first_rule:
            out.append(s)
        else:
            todo += [int(rules[s - first_rule, 1]), int(rules[s - first_rule, 0])]
    return out


def with_starts(spark, path: str, rows: DataFrame) -> DataFrame:
    """Adds ``start``, the number of ids of all documents before: parts first, then shards of a part, then the shard."""
    heads = spark.read.schema(STORE).parquet(path).select("part", "seq", "n_ids")
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = heads.select("part", "seq", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("shard_start"))
    base = inside.join(before, "part").select("part", "seq", (F.col("base") + F.col("shard_start")).alias("base"))
    return rows.join(base, ["part", "seq"]).withColumn("start", F.col("base") + F.col("at"))


def token_store(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Writes all documents to a new store in the shared folder and digests what is read back."""
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession)
    write_store(docs, tokenizer_path, end_id, path)
    rows = read_store(spark, path, with_ids=False)
    return with_starts(spark, path, rows).select("doc_id", "start", "n_tokens", "ids_crc32")
