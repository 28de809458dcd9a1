"""Operator 12: the prefix trie of conversations, by vertical bitmaps.

A node is a sequence of turns (role, text) with which at least one conversation begins; the root is
the empty one. Turns travel as a 128-bit digest, a number of words and their place, never as texts.

1. Turns are put in order by ranges of ids (``repartitionByRange``, so any spread of ids gives even
   tasks). A task cuts its stretch into shards of whole families (a family is the
   ids that may share turns when conversations are rebuilt) of about ``SHARD_CONVERSATIONS`` conversations.
2. In a shard (position, turn) is indexed to the bitset of the conversations that have it there. The
   trie is walked depth first: a child is the parent's bitset and one posting, its popcount the number of
   members, and the members of just that length are its end list. Each child costs one intersection: the first member that has
   not been given to a child names the next posting. Nodes get a number in that order and the number after their subtree.
3. Nodes of all shards meet by the digest of their whole sequence: sums and minima, so the
   root or a very common first turn is a row a shard. A node belongs to the shard with its smallest member.
4. Sums over subtrees are differences of running sums in walking order inside each shard, of what the shard owns
   (leaves, words) and of what is additive (members times words); shards add up. No step a level is needed, so depth doesn't matter.
5. End lists are hashed in order of ids by a stream over their blocks, a block a shard.

Ties: turns with equal numbers stand in order of their digest. Nulls: null turns come first, null roles and
texts are empty, rows without conv_id belong to no conversation and are left out. A row that repeats is one more turn.
An empty table gives no rows, not even a root. A conversation's turns (some 40 bytes each) are in one task together.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import materialize
from grainmill.llm.mixing import words

#: A shard ends with the first family that brings it to so many conversations, or turns.
SHARD_CONVERSATIONS, SHARD_TURNS = 4096, 65_536

LOCAL = (
    "shard long, pre int, stop int, parent_pre int, node binary, depth long, first long, n long, words long, branches boolean, ends binary"
)
_LOCAL = pa.schema([
    ("shard", pa.int64()), ("pre", pa.int32()), ("stop", pa.int32()), ("parent_pre", pa.int32()), ("node", pa.binary()), ("depth", pa.int64()), ("first", pa.int64()),
    ("n", pa.int64()), ("words", pa.int64()), ("branches", pa.bool_()), ("ends", pa.binary()),
])


def shared_turns(conv_id: int) -> int:
    """How many turns a conversation takes from its family's first: unsigned crc32 of the id as text, modulo 4."""
    return zlib.crc32(str(conv_id).encode()) % 4


def rebuilt(own: dict[int, tuple[int, int]], conv_id: int, family: int, share: Callable[[int], int]) -> list[tuple[int, int]]:
    """Stretches of turns that make up a conversation: the first ``share`` ones of its family's first, then its own after as many."""
    h = share(conv_id)
    a, b = own.get(family, (0, 0))
    c, d = own[conv_id]
    return [(a, min(a + h, b)), (min(c + h, d), d)]


def walk(ids: np.ndarray, sequences: list[np.ndarray], turn_digest: list[bytes], turn_words: np.ndarray) -> dict[str, list]:
    """The trie of one shard. ids ascend; sequences has each conversation's turns as indices of distinct turns."""
    postings: dict[tuple[int, int], int] = {}
    ends_at: dict[int, int] = {}
    for i, seq in enumerate(sequences):
        bit = 1 << i
        ends_at[len(seq)] = ends_at.get(len(seq), 0) | bit
        for p, turn in enumerate(seq):
            postings[p, turn] = postings.get((p, turn), 0) | bit
    out: dict[str, list] = {c: [] for c in ("stop", "parent_pre", "node", "depth", "first", "n", "words", "branches", "ends")}

    def bits(mask: int) -> list[int]:
        found = []
        while mask:
            low = mask & -mask
            found.append(low.bit_length() - 1)
            mask ^= low
        return found

    def add(mask: int, depth: int, parent: int, node: bytes, n_words: int) -> int:
        ending = mask & ends_at.get(depth, 0)
        values = (-1, parent, node, depth, int(ids[(mask & -mask).bit_length() - 1]), mask.bit_count(), n_words, mask != ending, ids[bits(ending)].tobytes() if ending else None)
        for c, v in zip(out, values, strict=True):
            out[c].append(v)
        return len(out["stop"]) - 1

    def below(node: bytes, turn: int) -> bytes:
        return hashlib.blake2b(node + turn_digest[turn], digest_size=16).digest()

    root = add((1 << len(sequences)) - 1, 0, -1, b"\0" * 16, 0)
    # (node, its members that go on and have not been given to a child yet, all its members)
    stack = [(root, (1 << len(sequences)) - 1 & ~ends_at.get(0, 0), (1 << len(sequences)) - 1)]
    while stack:
        at, rest, members = stack.pop()
        if not rest:
            out["stop"][at] = len(out["stop"])
            continue
        depth = out["depth"][at]
        turn = sequences[(rest & -rest).bit_length() - 1][depth]
        child = members & postings[depth, turn]
        stack.append((at, rest & ~child, members))
        new = add(child, depth + 1, at, below(out["node"][at], turn), int(turn_words[turn]))
        stack.append((new, child & ~ends_at.get(depth + 1, 0), child))
    return out


def _shard(rows: list[tuple[np.ndarray, ...]], number: int, share: Callable[[int], int]) -> pa.Table:
    conv, family, digest, n_words = (np.concatenate(x) for x in zip(*rows, strict=True))
    starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
    stops = np.r_[starts[1:], len(conv)]
    ids = conv[starts]
    own = {int(c): (int(a), int(b)) for c, a, b in zip(ids, starts, stops, strict=True)}
    distinct, where, code = np.unique(digest, return_index=True, return_inverse=True)
    sequences = [[t for a, b in rebuilt(own, int(c), int(family[a0]), share) for t in code[a:b].tolist()] for c, a0 in zip(ids, starts, strict=True)]
    out = walk(ids, sequences, [d.tobytes() for d in distinct], n_words[where])
    n = len(out["stop"])
    cols = {"shard": np.full(n, number), "pre": np.arange(n)} | out
    return pa.table([pa.array(cols[f.name], f.type) for f in _LOCAL], schema=_LOCAL)


def _shards(share: Callable[[int], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        number, size, convs, last = TaskContext.get().partitionId() << 32, 0, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            conv, family, n_words = (b.column(c).to_numpy() for c in ("conv_id", "family", "words"))
            fixed = b.column("digest").cast(pa.binary(16))
            digest = np.frombuffer(fixed.buffers()[1], "V16", len(fixed), fixed.offset * 16)
            # a shard may end before a row that begins a family
            for a, z in _stretches(family):
                if family[a] != last and (convs >= SHARD_CONVERSATIONS or size >= SHARD_TURNS):
                    yield from _shard(held, number, share).to_batches()
                    held, number, size, convs = [], number + 1, 0, 0
                held.append((conv[a:z], family[a:z], digest[a:z], n_words[a:z]))
                size, convs, last = size + z - a, convs + len(np.unique(conv[a:z])), family[a]
        if held:
            yield from _shard(held, number, share).to_batches()

    return run


def _stretches(values: np.ndarray) -> Iterator[tuple[int, int]]:
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return zip(starts.tolist(), [*starts[1:].tolist(), len(values)], strict=True)


SUMS = "node binary, depth long, conv_id long, parent_conv_id long, n long, n_children long, n_leaves long, saved long"
_SUMS = pa.schema([
    ("node", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()),
])


def _subtree_sums(t: pa.Table) -> pa.Table:
    """What one shard adds to each of its nodes' subtrees."""
    t = t.sort_by("pre")
    get = lambda c: t.column(c).to_numpy()
    stop, parent, n, n_words, first = get("stop"), get("parent_pre"), get("n"), get("words"), get("global_first")
    own = first == get("first")
    total = lambda x: (c := np.r_[0, np.cumsum(x)])[stop] - c[:-1]
    children = np.bincount(parent[own & (parent >= 0)], minlength=len(stop))
    up = pa.array(first[np.maximum(parent, 0)], mask=parent < 0)
    columns = {
        "node": t.column("node"), "depth": t.column("depth"), "conv_id": first, "parent_conv_id": up, "n": n, "n_children": children,
        "n_leaves": total((own & ~get("global_branches")).astype(np.int64)), "saved": total(n * n_words - own * n_words),
    }
    return pa.table({f.name: columns[f.name] for f in _SUMS}).cast(_SUMS)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of end lists; blocks come in order of (node, first id of the block)."""
    schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
    node, state = None, None
    for b in batches:
        done = []
        for key, ends in zip(b.column("node").to_pylist(), b.column("ends").to_pylist(), strict=True):
            ids = ",".join(map(str, np.frombuffer(ends, np.int64).tolist())).encode()
            if key == node:
                state.update(b"," + ids)
                continue
            if node is not None:
                done.append((node, state.hexdigest()))
            node, state = key, hashlib.sha256(ids)
        if done:
            yield pa.record_batch([pa.array(x) for x in zip(*done, strict=True)], schema=schema)
    if node is not None:
        yield pa.record_batch([pa.array([node]), pa.array([state.hexdigest()])], schema=schema)


def local_tries(conversations: DataFrame, family_size: int = 20, share: Callable[[int], int] = shared_turns) -> DataFrame:
    """The nodes of every shard's trie, see LOCAL."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), "utf-8"), 256), 1, 32))
    id_ = F.col("conv_id").cast("long")
    turns = conversations.where("conv_id is not null").select(id_.alias("conv_id"), (id_ - id_ % family_size).alias("family"), "turn", digest.alias("digest"), words(text).alias("words"))
    ordered = turns.repartitionByRange("family").sortWithinPartitions("family", "conv_id", F.asc_nulls_first("turn"), "digest")
    return ordered.mapInArrow(_shards(share), LOCAL)


def prefix_trie(conversations: DataFrame, family_size: int = 20, share: Callable[[int], int] = shared_turns) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    local = materialize(local_tries(conversations, family_size, share))
    known = local.groupBy("node").agg(F.min("first").alias("global_first"), F.max("branches").alias("global_branches"))
    placed = local.drop("ends").join(known, "node")
    sums = placed.groupBy("shard").applyInArrow(_subtree_sums, SUMS)
    nodes = sums.groupBy("node").agg(
        *(F.min(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id")), F.sum("n").alias("n_convs"), *(F.sum(c).alias(c) for c in ("n_children", "n_leaves")), F.sum("saved").alias("saved_tokens")
    )
    ends = local.where("ends is not null").select("node", "first", "ends").repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node binary, ends_sha256 string")
    empty = hashlib.sha256(b"").hexdigest()
    return nodes.join(ends, "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")
    )
