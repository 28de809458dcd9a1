"""Operator 3: packing token sequences by swap-based local search.

Documents are cut into pieces of at most ``capacity`` tokens (only longer ones are
cut). Pieces are written once, then dealt by a hash of their place in the input (so copies
spread like any other rows) to groups of about ``group_rows`` pieces, and each group packs its own: pieces in random order are put
where they fit, which leaves many bins underfull; then all of these exchange one piece for one, two for one, or move a piece, whenever that raises
the sum of squared fills, until no such step is left; bins that empty go. A group leaves
about one bin underfull, so the loss is one bin in some ten thousand.

Nulls: a null text is empty and is one piece, the end id. Repeated rows are packed
each. A null id is passed on. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import arrow_rows, materialize
from grainmill.llm.library_tokens import piece_table
from grainmill.llm.pieces import eased, frugal, in_batches

#: Whole texts that go to Python at once.
TEXT_ROWS = 1000
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, place bigint"


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, place[, ids]); ids as in packed_documents; place numbers the pieces over all partitions."""

    def run(batches):
        table = piece_table(tokenizer_path)
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            texts = [b or b"" for b in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, z in in_batches(texts):
                ids, n = table.ids(texts[a:z])
                ids = np.insert(ids, np.cumsum(n), end_id)
                n = n + 1
                stop = np.cumsum(n)
                raw = memoryview(ids.astype("<u4").tobytes())
                many = (n + capacity - 1) // capacity
                owner = np.repeat(np.arange(len(n)), many)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
                start = number * capacity
                length = np.minimum(capacity, n[owner] - start)
                first = (stop - n)[owner] + start
                crc = np.array([zlib.crc32(raw[4 * i : 4 * (i + k)]) for i, k in zip(first.tolist(), length.tolist())], np.int64)
                cols = [pa.array([doc_ids[a + i] for i in owner.tolist()], pa.int64()), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(place + np.arange(len(owner)))]
                place += len(owner)
                if with_ids:
                    flat = memoryview(ids.astype(table.item).tobytes())
                    size = np.dtype(table.item).itemsize
                    cols.append(pa.array([flat[size * i : size * (i + k)] for i, k in zip(first.tolist(), length.tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = PIECE + ", ids binary" * with_ids
    names = [c.split()[0] for c in kind.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(run, piece_table), kind)


def dealt(pieces: DataFrame, group_rows: int) -> DataFrame:
    """Written pieces with part, the group that packs the piece."""
    groups = max(1, -(-pieces.count() // group_rows))
    return pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "place"), F.lit(groups)))


def first_bins(length: np.ndarray, capacity: int, seed: int = 0) -> list[list[int]]:
    """Pieces in random order, each put into the fullest bin that has room; bins as lists of positions."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []
    for i in np.random.default_rng(seed).permutation(len(length)).tolist():
        k = int(length[i])
        at = bisect_left(rooms, k)
        if at == len(rooms):
            b, left = len(bins), capacity - k
            bins.append([i])
        else:
            r = rooms[at]
            b, left = room[r].pop(), r - k
            bins[b].append(i)
            if not room[r]:
                rooms.pop(at)
        if left:
            if not room[left]:
                insort(rooms, left)
            room[left].append(b)
    return bins


class _Donors:
    """For each length, and each sum of two lengths, the emptiest bin that holds it."""

    def __init__(self, capacity: int) -> None:
        self.low = np.full((2, 2 * capacity + 2), 1 << 40)
        self.heaps: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        self.held: dict[int, tuple[int, int, np.ndarray, np.ndarray]] = {}
        self.stamp = 0

    def put(self, b: int, fill: int, singles: np.ndarray, pairs: np.ndarray) -> None:
        self.stamp += 1
        self.held[b] = (self.stamp, fill, singles, pairs)
        for kind, keys in enumerate((singles, pairs)):
            for k in keys.tolist():
                heappush(self.heaps.setdefault((kind, k), []), (fill, b, self.stamp))
            self.low[kind][keys] = np.minimum(self.low[kind][keys], fill)

    def drop(self, b: int) -> None:
        if b not in self.held:
            return
        _, fill, *held = self.held.pop(b)
        for kind, keys in enumerate(held):
            for k in keys[self.low[kind][keys] == fill].tolist():
                heap = self.heaps[kind, k]
                while heap and self.held.get(heap[0][1], (0,))[0] != heap[0][2]:
                    heappop(heap)
                self.low[kind, k] = heap[0][0] if heap else 1 << 40

    def emptiest(self, kind: int, k: int) -> int:
        return self.heaps[kind, k][0][1]


def _sums(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different lengths of a bin (some 90 at most, as they add up to the capacity) and the sums of two pieces."""
    singles, many = np.unique(own, return_counts=True)
    i, j = np.triu_indices(len(singles))
    return singles, np.unique((singles[i] + singles[j])[(i != j) | (many[i] > 1)])


def local_search(bins: list[list[int]], length: np.ndarray, capacity: int) -> list[list[int]]:
    """Moves and exchanges (one for one, two for one, one for two) between all bins with room, until none raises the sum of squared fills.

    A step of net gain g from bin a to b raises the sum if g > fill a - fill b, so for each
    length only the emptiest bin that holds it matters, and a step looks it up. Full bins
    can take no part. The sum of squares is bounded, so the search ends.
    """
    bins = [list(b) for b in bins]
    fill = [int(length[b].sum()) for b in bins]

    def find(b: int, singles: np.ndarray, pairs: np.ndarray) -> tuple[int, int, int] | None:
        """The step of largest gain into b: gain, what b gives for it (a length, a sum or 0), kind of what it takes."""
        gains = np.arange(1, capacity - fill[b] + 1)
        best = None
        for given, kind in ((np.append(0, singles), 0), (singles, 1), (pairs, 0)):
            for at in range(0, len(given), 256):
                ys = given[at : at + 256]
                ok = donors.low[kind][ys[:, None] + gains] - fill[b] < gains
                hit = np.flatnonzero(ok.any(0))
                if len(hit) and (best is None or gains[hit[-1]] > best[0]):
                    best = (int(gains[hit[-1]]), int(ys[ok[:, hit[-1]].argmax()]), kind)
        return best

    def taken(b: int, k: int, two: bool) -> list[int]:
        """One piece of length k of the bin, or two of that sum."""
        seen: dict[int, int] = {}
        for i in bins[b]:
            n = int(length[i])
            if not two and n == k:
                return [i]
            if two and k - n in seen:
                return [seen[k - n], i]
            seen[n] = i
        return []

    again = True
    while again:
        again = False
        under = sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: -fill[b])
        donors = _Donors(capacity)
        for b in under:
            donors.put(b, fill[b], *_sums(length[bins[b]]))
        for b in under:
            if not 0 < fill[b] < capacity:
                continue
            keys = donors.held[b][2:]
            donors.drop(b)
            while fill[b] < capacity and (step := find(b, *keys)):
                again = True
                gain, out, kind = step
                a = donors.emptiest(kind, out + gain)
                donors.drop(a)
                give, take = (taken(b, out, False) or taken(b, out, True)) if out else [], taken(a, out + gain, kind == 1)
                bins[a] = [i for i in bins[a] if i not in take] + give
                bins[b] = [i for i in bins[b] if i not in give] + take
                fill[a] -= gain
                fill[b] += gain
                if fill[a]:
                    donors.put(a, fill[a], *_sums(length[bins[a]]))
                keys = _sums(length[bins[b]])
            if fill[b] < capacity:
                donors.put(b, fill[b], *keys)
    return [b for b in bins if b]


def _pack(key, frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    frame = frame.sort_values("place").reset_index(drop=True)
    length = frame["length"].to_numpy()
    bins = local_search(first_bins(length, capacity), length, capacity)
    order = np.array([i for b in bins for i in b])
    number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    n = length[order]
    total = np.cumsum(n) - n
    first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    out = frame.iloc[order].drop(columns="part")
    out["sequence_id"] = (int(key[0]) << 40) + number
    out["offset"] = total - np.repeat(total[first], np.diff(np.append(first, len(n))))
    return out


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces; groups of bounded size, dealt by ``part``."""
    cols = [f for f in pieces.schema.fields if f.name != "part"]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols) + ", sequence_id bigint, offset bigint"
    return pieces.groupBy("part").applyInPandas(lambda key, frame: eased(_pack, key, frame, capacity), kind)


def packed_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, group_rows: int = 20_000, with_ids: bool = False) -> DataFrame:
    """All pieces with their sequence and offset, and with their ids if asked for, as little-endian unsigned integers of
    two bytes (four where the vocabulary has more than 65,536 entries): these do not travel through the search, but meet its result by place."""
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        pieces = materialize(token_pieces(docs, tokenizer_path, end_id, capacity, with_ids))
    packed = pack(dealt(pieces.drop("ids"), group_rows), capacity)
    if with_ids:
        packed = packed.join(pieces.select("place", "ids").hint("merge"), "place")
    return packed.drop("place")
