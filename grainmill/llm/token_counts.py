"""Operator 8: token counts by rank-synchronous array merging.

Texts are cut into pieces (pieces.py) and these, by the vocabulary's own pattern,
into pre-tokens. New distinct pre-tokens are held as one ragged numpy array of
symbols. In every round each pre-token's lowest-rank pair is found, and all its
occurrences are merged, for all pre-tokens at the same time; a pre-token without a
pair that merges has its number of surviving symbols as count. Very long pre-tokens keep their places in a queue by
rank, so that a round costs what it changes.

Nulls: a null text counts as empty (0 bytes, 0 tokens). Repeated rows are counted
each. Other columns are not read. A null id is passed on. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.library_tokens import BYTE_ALPHABET, _PLAIN
from grainmill.llm.pieces import PieceTable, byte_level_cuts, frugal, in_batches, kept

_NONE = np.int64(2**40)
#: Pre-tokens of more bytes are merged one by one, with queues of places.
LONG = 512


class PairRanks:
    """Open-addressed table from a pair of symbols to its rank."""

    def __init__(self, pairs: np.ndarray, bits: int = 20) -> None:
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, _NONE, np.int64)
        self.mask = (1 << bits) - 1
        left, self.probes = np.arange(len(pairs)), 0
        while len(left):
            slot = (self._slot(pairs[left]) + self.probes) & self.mask
            free = self.keys[slot] == -1
            self.keys[slot[free]] = pairs[left[free]]
            won = self.keys[slot] == pairs[left]
            self.ranks[slot[won]] = left[won]
            left, self.probes = left[~won], self.probes + 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        rank = np.full(len(key), _NONE, np.int64)
        left, base = np.arange(len(key)), self._slot(key)
        for step in range(self.probes):
            slot = (base[left] + step) & self.mask
            got = self.keys[slot]
            hit = got == key[left]
            rank[left[hit]] = self.ranks[slot[hit]]
            left = left[~hit & (got != -1)]
            if not len(left):
                break
        return rank


class MergeModel:
    """The merges of a byte-level vocabulary file, as arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.width = np.int64(1 << 17)
        self.ranks = PairRanks(np.array([vocab[a] * (1 << 17) + vocab[b] for a, b in merges], np.int64))
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.byte = np.array([vocab[BYTE_ALPHABET[b]] for b in range(256)], np.int64)
        self.special = [t["content"] for t in spec["added_tokens"]]

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each pre-token."""
        out = np.fromiter(map(len, words), np.int64, len(words))
        long = np.flatnonzero(out > LONG)
        if len(long):
            out[long] = [self.long_count(words[i]) for i in long]
            rest = np.setdiff1d(np.arange(len(words)), long)
            if len(rest):
                out[rest] = self._together([words[i] for i in rest])
            return out
        return self._together(words)

    def long_count(self, word: bytes) -> int:
        """The same for one long pre-token, where a round touches only what it changes.

        Places wait in a queue by the rank of the pair that begins there; neighbours are linked. A round takes all places of the
        lowest rank, merges them at once and ranks the pairs beside them again, so a text without a break costs about its length.
        """
        sym = self.byte[np.frombuffer(word, np.uint8)]
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n + 1, _NONE, np.int64)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(at: np.ndarray) -> None:
            """Ranks the pairs that begin at these places, and lets them wait."""
            at = at[after[at] < n]
            rank[at] = self.ranks.find(sym[at] * self.width + sym[after[at]])
            at = at[rank[at] < _NONE]
            if not len(at):
                return
            order = np.argsort(rank[at], kind="stable")
            at, r = at[order], rank[at[order]]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
                key = int(r[a])
                if key not in waiting:
                    waiting[key] = []
                    heapq.heappush(ranks, key)
                waiting[key].append(at[a:z])

        wait(np.arange(n))
        left = n
        while ranks:
            lowest = heapq.heappop(ranks)
            parts = waiting.pop(lowest)
            at = np.unique(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])
            at = at[rank[at] == lowest]
            if not len(at):
                continue
            run = np.append(False, after[at[:-1]] == at[1:])  # overlapping occurrences, such as a a a: every second one counts
            if run.any():
                pos = np.arange(len(at))
                at = at[((pos - np.maximum.accumulate(np.where(run, 0, pos))) & 1) == 0]
            gone = after[at]
            sym[at] = self.merged[lowest]
            rank[gone] = _NONE
            rank[at] = _NONE
            beyond = after[gone]
            after[at] = beyond
            inside = beyond < n
            before[beyond[inside]] = at[inside]
            left -= len(at)
            back = before[at]
            back = back[back >= 0]
            rank[back] = _NONE
            wait(np.unique(np.concatenate([back, at])))
        return left

    def _together(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), out)
        while len(sym) > 1:
            inside = owner[:-1] == owner[1:]
            rank = np.full(len(sym), _NONE, np.int64)
            at = np.flatnonzero(inside)
            rank[at] = self.ranks.find(sym[at] * self.width + sym[at + 1])
            first = np.flatnonzero(np.append(True, ~inside))
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(sym))))
            hit = (rank == lowest) & (rank < _NONE)
            if not hit.any():
                break
            run = hit & np.append(False, hit[:-1])  # overlapping occurrences, such as a a a: every second one counts
            if run.any():
                pos = np.arange(len(sym))
                begin = np.maximum.accumulate(np.where(hit & ~run, pos, 0))
                hit &= ((pos - begin) & 1) == 0
            spots = np.flatnonzero(hit)
            sym[spots] = self.merged[rank[spots]]
            np.subtract.at(out, owner[spots], 1)
            stay = np.append(True, ~hit[:-1])
            stay &= lowest < _NONE  # finished pre-tokens leave
            sym, owner = sym[stay], owner[stay]
        return out


@kept
def count_table(path: str, pattern: str) -> PieceTable:
    import regex

    model, find = MergeModel(path), regex.compile(pattern).findall
    special = regex.compile("(" + "|".join(map(regex.escape, model.special)) + ")") if model.special else None

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words: dict[bytes, int] = {}
        use, owner, extra = [], [], np.zeros(len(pieces), np.int64)
        for i, piece in enumerate(pieces):
            text = piece.decode("utf-8", "replace")
            if _PLAIN.fullmatch(text):
                use.append(words.setdefault(piece, len(words)))
                owner.append(i)
                continue
            for k, part in enumerate(special.split(text) if special else [text]):
                if k % 2:
                    extra[i] += 1
                    continue
                for word in find(part):
                    use.append(words.setdefault(word.encode("utf-8", "replace"), len(words)))
                    owner.append(i)
        n = model.counts(list(words))
        width = extra + np.bincount(np.array(owner, np.int64), weights=n[np.array(use, np.int64)] if use else None, minlength=len(pieces)).astype(np.int64)
        return width, np.zeros(0, np.int32)

    return PieceTable(byte_level_cuts, encode)


def token_counts(docs: DataFrame, tokenizer_path: str, pattern: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit); one narrow pass, no shuffle."""

    def run(batches):
        table = count_table(tokenizer_path, pattern)
        for batch in batches:
            texts = [b or b"" for b in batch.column(1).cast(pa.binary()).to_pylist()]
            n = np.zeros(len(texts), np.int64)
            for a, z in in_batches(texts):
                width, _, first, stop = table.lookup(texts[a:z])
                total = np.concatenate([[0], np.cumsum(width)])
                n[a:z] = total[stop] - total[first]
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(frugal(run, count_table), f"{id_col} {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
