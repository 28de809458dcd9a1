"""Operator 1: near-duplicate documents by an inverted join of MinHash signature coordinates.

1. Every text becomes the set of its distinct 5-word shingles (64-bit hashes), a
   fingerprint of that set and a signature of ``COORDS`` coordinates. Documents with equal sets
   are one class with its smallest id as representative; only representatives go on.
2. Representatives are posted under each coordinate-value pair. Two sets with a Jaccard
   similarity of 0.75 agree in fewer than ``MATCHES`` of 40 coordinates with a probability
   of about 1 in 100,000. So a representative that shares s posted values can skip
   the MATCHES - 1 most frequent of them (prefix): a pair with enough collisions still meets
   in one of the first s - MATCHES + 1 lists, in ascending order of length.
3. Each list names its most connected member as head. First every representative is compared with one head only, the
   most connected of its lists: collisions are counted, and pairs of MATCHES or more confirmed on full
   sets. That joins a group of near copies with a comparison for each member.
4. Lists whose members all are joined by now are skipped. In the others collisions are counted
   between members not joined yet, lists of one head together; pairs below MATCHES are dropped, the others confirmed on full sets.
   Small lists share a task; long ones are cut into blocks, a task for each two blocks.
   Tasks return spanning forests of the links, not all pairs.
5. Components of the links, and of the classes, give each document its component.

Members of different lists never meet, so a long chain of documents that are each like the next costs
as many comparisons as its lists are long. All members of one list are compared only where they are neither equal nor joined by a head.

Nulls: a null or empty text, or one of white space alone, has an empty set and links with nothing; it is its
own component. A row without an id links with nothing, and component_id and kept are null.
Rows that repeat an id are one node with the links of all their texts. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.common import connected_components, materialize
from grainmill.llm.pieces import _SPACE, eased, frugal, hashes, in_batches

COORDS, MATCHES = 40, 18
SHINGLE = 5
#: Members of a block, and shingles of a block, at most about.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
#: Up to this number of ids (8 bytes each) is broadcast to pick texts; above, the join shuffles.
BROADCAST_IDS = 500_000

_RNG = np.random.default_rng(7)
_STEP = _RNG.integers(1, 2**63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(0, 2**63, COORDS, dtype=np.uint64)
_MUL = _RNG.integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(k)
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    start, stop = edge[::2], edge[1::2]
    word = hashes(data, start, stop)
    ends = np.cumsum([len(t) + 1 for t in texts])
    last = np.searchsorted(start, ends)
    many = max(0, len(word) - SHINGLE + 1)
    run = np.zeros(many, np.uint64)
    for k in range(SHINGLE):
        run += word[k : k + many] * _STEP[k]
    run = _mix(_mix(run, 0xBF58476D1CE4E5B9), 0x94D049BB133111EB)
    out, a = [], 0
    for z in last.tolist():
        if z - a >= SHINGLE:
            out.append(np.unique(run[a : z - SHINGLE + 1]))
        elif z > a:
            with np.errstate(over="ignore"):
                h = (word[a:z] * _STEP[: z - a]).sum(dtype=np.uint64) + _STEP[SHINGLE] * np.uint64(z - a)
            out.append(_mix(np.array([h], np.uint64), 0xBF58476D1CE4E5B9))
        else:
            out.append(np.zeros(0, np.uint64))
        a = z
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """COORDS minima of each set, each told apart by its coordinate; sets are not empty."""
    flat = np.concatenate(sets)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    first = np.cumsum(size) - size
    out = np.empty((len(sets), COORDS), np.uint64)
    for k in range(COORDS):
        out[:, k] = np.minimum.reduceat((flat ^ _XOR[k]) * _MUL[k], first) * np.uint64(2) + np.uint64(1)
        out[:, k] = _mix(out[:, k] ^ _XOR[k], 0x94D049BB133111EB)
    return out.view(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_shingles, fp1, fp2, sig); sig is null for an empty set."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            texts = [b or b"" for b in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, z in in_batches(texts, 500_000):
                sets = shingle_sets(texts[a:z])
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                full = np.flatnonzero(size)
                fp = np.zeros((2, len(sets)), np.int64)
                sig: list = [None] * len(sets)
                if len(full):
                    some = [sets[i] for i in full.tolist()]
                    flat = np.concatenate(some)
                    first = np.cumsum(size[full]) - size[full]
                    for k, c in enumerate((0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)):
                        fp[k, full] = np.add.reduceat(_mix(flat, c), first).view(np.int64)
                    for i, s in zip(full.tolist(), signatures(some)):
                        sig[i] = s
                cols = [ids.slice(a, z - a), pa.array(size), pa.array(fp[0]), pa.array(fp[1]), pa.array(sig, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "fp1", "fp2", "sig"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(run), "doc_id bigint, n_shingles bigint, fp1 bigint, fp2 bigint, sig array<bigint>")


def prefix_posts(reps: DataFrame) -> DataFrame:
    """Rows (rep, key, weight): the values that each representative must be looked up by."""
    posts = reps.select("rep", F.explode("sig").alias("key"))
    often = posts.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = posts.join(often, "key")
    own = Window.partitionBy("rep")
    ranked = shared.select("rep", "key", F.count(F.lit(1)).over(own).alias("s"), F.sum("df").over(own).alias("weight"), F.row_number().over(own.orderBy("df", "key")).alias("r"))
    return ranked.where((F.col("s") >= MATCHES) & (F.col("r") <= F.col("s") - MATCHES + 1)).select("rep", "key", "weight")


def list_heads(posts: DataFrame) -> DataFrame:
    """Rows (key, head, weight, n) of lists of several members; the head is the member that shares the most posts."""
    heads = posts.groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("r"))).alias("h"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return heads.select("key", (-F.col("h.r")).alias("head"), F.col("h.weight").alias("weight"), "n")


def stars(posts: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows (rep, head): for each representative the most connected head of its lists, if that is another one."""
    best = posts.select("rep", "key").join(heads, "key").groupBy("rep").agg(F.max(F.struct("weight", (-F.col("head")).alias("h"))).alias("b"))
    return best.select("rep", (-F.col("b.h")).alias("head")).where("rep <> head")


def unjoined_lists(posts: DataFrame, heads: DataFrame, joined: DataFrame) -> DataFrame:
    """Rows (rep, head, part): members of lists with members of different parts, by the list's head; ``joined`` has rep and part."""
    members = posts.select("rep", "key").join(joined, "rep", "left").select("rep", "key", F.coalesce("part", "rep").alias("part"))
    mixed = members.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("z")).where("a <> z").join(heads.select("key", "head"), "key").select("key", "head")
    return members.join(mixed, "key").select("rep", "head", "part").distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray], dense_from: int = 32) -> np.ndarray:
    """Sizes of the intersections of each left set with each right set."""
    n, both = len(left), [*left, *right]
    size = np.fromiter(map(len, both), np.int64, len(both))
    owner = np.repeat(np.arange(len(both)), size)
    value, col, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    out = np.zeros(n * len(right), np.float32)
    rare = (count[col] > 1) & (count[col] < dense_from)
    order = np.argsort(col[rare], kind="stable")
    c, o = col[rare][order], owner[rare][order]
    for step in range(1, dense_from):
        if step >= len(c):
            break
        hit = (c[step:] == c[:-step]) & (o[:-step] < n) & (o[step:] >= n)
        if hit.any():
            out += np.bincount(o[:-step][hit] * len(right) + o[step:][hit] - n, minlength=len(out)).astype(np.float32)
        elif not (c[step:] == c[:-step]).any():
            break
    out = out.reshape(n, len(right))
    frequent = np.flatnonzero(count >= dense_from)
    number = np.full(len(value), -1, np.int64)
    number[frequent] = np.arange(len(frequent))
    often = number[col]
    for lo in range(0, len(frequent), 2048):
        here = (often >= lo) & (often < lo + 2048)
        m = np.zeros((len(both), min(2048, len(frequent) - lo)), np.float32)
        m[owner[here], often[here] - lo] = 1
        out += m[:n] @ m[n:].T
    return out


def _alike(left: list[np.ndarray], right: list[np.ndarray], percent: int, apart: np.ndarray | None = None) -> np.ndarray:
    """True where 100 * intersection >= percent * union, among pairs with enough collisions (and ``apart``)."""
    near = overlaps(list(np.sort(signatures(left), 1)), list(np.sort(signatures(right), 1))) >= MATCHES
    if apart is not None:
        near &= apart
    rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    out = np.zeros(near.shape, bool)
    if len(rows):
        l, r = [left[i] for i in rows], [right[j] for j in cols]
        both = overlaps(l, r).astype(np.int64)  # 100 times a large count would be rounded otherwise
        total = np.array([len(s) for s in l])[:, None] + np.array([len(s) for s in r])[None, :]
        out[np.ix_(rows, cols)] = 100 * both >= percent * (total - both)
        out &= near
    return out


def _forest(alike: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what ``alike`` connects: each member to the smallest position it reaches."""
    n = len(left)
    same = n == len(right) and bool((left == right).all())
    a, b = np.arange(n), np.arange(n) if same else n + np.arange(len(right))
    big = n + len(right)
    while True:
        if same:
            new = np.minimum(a, np.where(alike, a[None, :], big).min(1))
            new = np.minimum(new, new[new])
            if (new == a).all():
                break
            a = b = new
        else:
            nb = np.minimum(b, np.where(alike, a[:, None], big).min(0))
            na = np.minimum(a, np.where(alike, nb[None, :], big).min(1))
            if (na == a).all() and (nb == b).all():
                break
            a, b = na, nb
    ids = left if same else np.concatenate([left, right])
    label = a if same else np.concatenate([a, b])
    return [(int(ids[i]), int(ids[k])) for i, k in enumerate(label) if i != k]


def _sets(frame: pd.DataFrame) -> list[np.ndarray]:
    texts = [t.encode("utf-8", "replace") for t in frame["text"]]
    return [s for a, z in in_batches(texts, 500_000) for s in shingle_sets(texts[a:z])]


def _groups(*keys: np.ndarray) -> list[np.ndarray]:
    """Positions of each group of equal keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return np.split(order, np.flatnonzero(new))


def _compare_with_heads(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Edges (a, b) from members to the head they are like; side 1 is the head's own text."""
    frame = frame.drop_duplicates(["head", "rep", "text"])
    sets, edges = _sets(frame), []
    rep, side, head = (frame[c].to_numpy() for c in ("rep", "side", "head"))
    for at in _groups(head):
        l, r = at[side[at] == 0], at[side[at] == 1]
        if len(l) and len(r):
            alike = _alike([sets[i] for i in l], [sets[i] for i in r], percent).any(1)
            edges += [(int(rep[i]), int(head[i])) for i in l[alike]]
    return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")


def _compare(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Edges (a, b) of spanning forests of the links between members of different parts."""
    frame = frame.drop_duplicates(["head", "rep", "text"]).sort_values(["head", "rep"])
    sets, edges = _sets(frame), []
    rep, side, head, part = (frame[c].to_numpy() for c in ("rep", "side", "head", "part"))
    for at in _groups(head):
        l, r = at[side[at] != 1], at[side[at] != 0]
        if len(l) and len(r):
            alike = _alike([sets[i] for i in l], [sets[i] for i in r], percent, part[l][:, None] != part[r][None, :])
            edges += _forest(alike, rep[l], rep[r])
    return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")


def _texts_of(docs: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """The texts of the ids in ``wanted`` (rep and more), each different text of an id once."""
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("rep"), "text")
    if repeated:
        texts = texts.join(wanted.select("rep").distinct(), "rep", "left_semi").distinct()
    return texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "rep")


def star_links(docs: DataFrame, pairs: DataFrame, repeated: bool, percent: int) -> DataFrame:
    """Edges (a, b) of the pairs (rep, head) that are alike. The members of a large star meet copies of its head in several tasks."""
    size = pairs.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("salts"))
    sides = pairs.join(size, "head").select("rep", "head", "salts", F.array(F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int")).alias("salt"), F.lit(0).alias("side"))
    own = size.select(F.col("head").alias("rep"), "head", "salts", F.sequence(F.lit(0), F.col("salts") - 1).alias("salt"), F.lit(1).alias("side"))
    wanted = materialize(sides.unionByName(own))
    spread = F.lit(max(1, wanted.count() // 500))
    task = F.when(F.col("salts") == 1, F.pmod(F.xxhash64("head"), spread)).otherwise(F.xxhash64("head", "s"))
    rows = _texts_of(docs, wanted, repeated).withColumn("s", F.explode("salt")).select(task.alias("task"), "rep", "head", "side", "text")
    return rows.groupBy("task").applyInPandas(lambda frame: eased(_compare_with_heads, frame, percent), "a bigint, b bigint")


def list_links(docs: DataFrame, members: DataFrame, repeated: bool, percent: int) -> DataFrame:
    """Edges (a, b) between members (rep, head, part, n_shingles) of lists of one head."""
    size = members.groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    size = size.where("n > 1").withColumn("blocks", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int"))
    members = materialize(members.join(size.select("head", "blocks"), "head"))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    # side 0 and 1: first and second block of a task; 2: both, where a block meets itself
    other = F.expr("transform(sequence(0, blocks - 1), x -> named_struct('i', least(x, block), 'j', greatest(x, block), 'side', if(x = block, 2, if(block < x, 0, 1))))")
    spread = F.lit(max(1, members.count() // 500))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("head"), spread)).otherwise(F.xxhash64("head", "t.i", "t.j"))
    rows = _texts_of(docs, members, repeated).withColumn("block", block).withColumn("t", F.explode(other))
    rows = rows.select(task.alias("task"), "rep", "head", "part", "text", F.col("t.side").alias("side"))
    return rows.groupBy("task").applyInPandas(lambda frame: eased(_compare, frame, percent), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept)."""
    prints = materialize(fingerprints(docs))
    full = prints.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("rows_"), F.count_distinct("doc_id").alias("ids"))
    classes = materialize(classes)
    repeated = not classes.groupBy("rep").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("rows_") > F.col("ids")).alias("same")).where("n > 1 or same").isEmpty()
    posts = materialize(prefix_posts(classes.select("rep", "sig")))
    heads = materialize(list_heads(posts))
    first = materialize(star_links(docs, stars(posts, heads), repeated, percent))
    parts = connected_components(first).select(F.col("id").alias("rep"), F.col("component").alias("part"))
    sizes = classes.groupBy("rep").agg(F.max("n_shingles").alias("n_shingles"))
    rest = unjoined_lists(posts, heads, parts).join(sizes, "rep")
    rest = materialize(list_links(docs, rest, repeated, percent))
    # links between parts join whole parts
    of = lambda side: parts.select(F.col("rep").alias(side), F.col("part").alias(f"{side}_"))
    between = rest.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_", "a").alias("a"), F.coalesce("b_", "b").alias("b"))
    whole = connected_components(between).select(F.col("id").alias("part"), "component")
    named = classes.select("fp1", "fp2", "n_shingles", "rep").join(parts, "rep", "left").withColumn("part", F.coalesce("part", "rep")).join(whole, "part", "left")
    named = named.select("fp1", "fp2", "n_shingles", F.coalesce("component", "part").alias("component_id"))
    rows = prints.drop("sig").join(named, ["fp1", "fp2", "n_shingles"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", "n_shingles", own.alias("component_id"), (F.col("doc_id") == own).alias("kept"))
