"""Operators 4 and 10: near-duplicate vectors and nearest neighbours.

Vectors that are null or empty, have a null or non-finite component, or are zero take no part:
operator 4 gives them a row of their own without links, operator 10 no row. Vectors of another
length than most take no part either. A null id takes no part (operator 4: null component).
Equal vectors are one class everywhere, so copies cost nothing but their count. Rows that repeat an
id count as vectors of their own: operator 4 gives each row the links of its own vector, and their id is one node of the
components; operator 10 takes no row with the query's id for a candidate. Ties go to the
smaller id. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from grainmill.llm.common import connected_components, drawn, materialize

#: Vectors that fit the rotations, and that give the cuts of the kd-tree of cells, at most about.
FIT_SAMPLE, CUT_SAMPLE = 4096, 1 << 16
#: Hamming tables of balanced codes; the tables of random_tables come on top.
TABLES = 12
#: Probability that a pair exactly at the threshold meets in none of the random tables, however many bits a key has.
MISS = 0.01
#: Vectors of a bucket that are compared in one task, and about the number a bucket should have.
BLOCK, BUCKET = 2048, 256
#: Random bits of a code, at least; beyond those of the tables they serve to tell candidates from others.
CHECK_BITS = 256
#: Standard deviations that the Hamming distance of a pair at the threshold may lie above its mean (1 in 30,000 does).
SLACK = 4.0
#: Candidates for each vector of a bucket beyond which a task does not name them but asks for the vectors.
DENSE = 8


def usable(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, v), written; v has the components as little-endian floats or doubles, and is null where a vector takes no part."""
    kind = "<f4" if isinstance(rows.schema["embedding"].dataType.elementType, FloatType) else "<f8"

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            at, holes = lists.offsets.to_numpy(), np.asarray(lists.values.is_null())
            values = lists.values.cast(pa.float32() if kind == "<f4" else pa.float64()).to_numpy(zero_copy_only=False)
            fine = np.isfinite(values) & ~holes
            out: list = []
            for i, (a, z) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                good = z > a and ids[i].is_valid and lists[i].is_valid and fine[a:z].all() and values[a:z].any()
                out.append(values[a:z].astype(kind).tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary())], names=["vec_id", "v"])

    found = materialize(rows.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id bigint, v binary"))
    widths = found.where("v is not null").groupBy(F.octet_length("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").first()
    return found.withColumn("v", F.when(F.octet_length("v") == (widths["w"] if widths else 0), F.col("v")))


#: Products this near the threshold are computed again by the formula of single pairs.
NEAR_LIMIT = 1e-12


def item_type(rows: DataFrame) -> str:
    return "<f4" if isinstance(rows.schema["embedding"].dataType.elementType, FloatType) else "<f8"


def matrix(values, kind: str) -> np.ndarray:
    raw = b"".join(values)
    return np.frombuffer(raw, kind).reshape(len(values), -1).astype(float)


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component near 1: squares of huge and tiny ones stay finite, no bit is lost."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None]) if x.size else x


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``x`` with the same row of ``y``, both scaled: the one formula that decides."""
    return (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))


def _sample(found: DataFrame, n: int, most: int, kind: str) -> np.ndarray:
    rows = found.where(drawn([F.col("v")], "fit", most / max(1, n))).select("v").limit(2 * most).collect()  # bounded by ``most``
    if n and not rows:
        rows = found.select("v").limit(2).collect()
    return matrix(sorted(bytes(r["v"]) for r in rows), kind) if rows else np.zeros((0, 1))


class Quantiser:
    """Iterative quantisation (Gong and Lazebnik): rotations that balance binary codes.

    The centred sample is turned to its principal axes; each rotation alternates
    between the nearest binary codes and the orthogonal turn that fits them best.
    ``random`` more bits are sides of random planes through the origin: their chance to
    part two vectors is the angle over pi, whatever the data.
    """

    def __init__(self, x: np.ndarray, bits: int, random: int = 0, steps: int = 40) -> None:
        x = scaled(x)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.mean = x.mean(0)
        _, axes = np.linalg.eigh(np.cov((x - self.mean).T).reshape(x.shape[1], -1))
        z = (x - self.mean) @ axes
        turns = []
        for seed in range(-(-bits // z.shape[1])):
            r = np.linalg.qr(np.random.default_rng(seed).normal(size=(z.shape[1],) * 2))[0]
            for _ in range(steps):
                u, _, w = np.linalg.svd(np.where(z @ r >= 0, 1.0, -1.0).T @ z)
                r = (u @ w).T
            turns.append(axes @ r)
        self.turn = np.hstack(turns)[:, :bits]
        self.planes = np.random.default_rng(97).normal(size=(x.shape[1], random))

    def bits(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.mean) @ self.turn >= 0, x @ self.planes >= 0])


def table_bits(n: int) -> int:
    """Bits of a table's key: some BUCKET vectors a bucket."""
    return int(min(30, max(1, np.log2(max(n, 2) / BUCKET))))


def random_tables(b: int, least: float) -> int:
    """Tables of b random bits that a pair of cosine ``least`` misses all with probability MISS at most; nearer pairs less."""
    meet = (1 - np.arccos(np.clip(least, -1, 1)) / np.pi) ** b
    return 1 if meet >= 1 - MISS else int(np.ceil(np.log(MISS) / np.log1p(-meet)))


def distance_limit(random: int, least: float) -> int:
    """Random bits in which a pair of cosine ``least`` or more may differ."""
    p = float(np.arccos(np.clip(least, -1, 1)) / np.pi)
    return int(np.floor(p * random + SLACK * np.sqrt(random * p * (1 - p)) + 1))


def near_vectors(rows: DataFrame, least: float = 0.9) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept): all pairs found with cosine >= ``least``.

    The code of a vector (a bit for each dimension of each rotation, then for each random plane) is cut into substrings,
    each the key of one Hamming table; vectors that agree in a substring meet. Keys grow with
    the table, and so does the number of random tables, which keeps the miss rate at MISS. Only codes travel to the tables:
    pairs whose codes are near enough are candidates, each named by the first table where it meets, and
    their original vectors are fetched once to rerank them. A bucket where that would name most pairs fetches
    its vectors instead, in blocks. A task takes many buckets; a bucket of more than BLOCK vectors
    is split, a task for each two blocks. Tasks return counts and spanning forests, or a bounded number of pairs.
    """
    kind = item_type(rows)
    found = usable(rows)
    good = found.where("v is not null")
    classes = materialize(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("row", F.monotonically_increasing_id()))
    m = classes.count()
    edges = _class_links(classes, m, least, kind) if m > 1 else classes.sparkSession.createDataFrame([], EDGES)
    edges = materialize(edges)
    counts = edges.where("kind = 0").groupBy(F.col("a").alias("row")).agg(F.sum("b").alias("links"))
    component = connected_components(edges.where("kind = 1").select("a", "b")).withColumnRenamed("id", "rep")
    told = classes.join(counts, "row", "left").join(component, "rep", "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("part"))
    out = good.join(told, "v").unionByName(found.where("v is null").withColumns({"links": F.lit(0).cast("long"), "part": F.col("vec_id")}))
    return out.select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("part").alias("component_id"), (F.col("vec_id") == F.col("part")).alias("kept"))


EDGES = "kind int, a bigint, b bigint"


def _class_links(classes: DataFrame, m: int, least: float, kind: str) -> DataFrame:
    """Links between different vectors. Kind 0: a row and the number of vectors that it links with; kind 1: edges of forests over ids."""
    b = table_bits(m)
    tables = TABLES + random_tables(b, least)
    random = max(b * (tables - TABLES), CHECK_BITS)
    model = Quantiser(_sample(classes, m, FIT_SAMPLE, kind), b * TABLES, random)
    limit = distance_limit(random, least)

    def code(batches):
        for batch in batches:
            if batch.num_rows:
                v = scaled(matrix(batch.column(1).to_pylist(), kind))
                bits = model.bits(v / np.linalg.norm(v, axis=1, keepdims=True))
                keys = _keys(bits[:, : b * tables], b)
                packed = [x.tobytes() for x in np.packbits(bits, axis=1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array(list(keys), pa.list_(pa.int32()))], names=["row", "code", "keys"])

    coded = materialize(classes.select("row", "v").mapInArrow(code, "row bigint, code binary, keys array<int>"))
    posts = coded.select("row", "code", F.posexplode("keys").alias("t", "key"))
    sizes = coded.select(F.posexplode("keys").alias("t", "key")).groupBy("t", "key").agg(F.count(F.lit(1)).alias("m"))
    large = sizes.where(F.col("m") > BLOCK).select("t", "key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    posts = posts.join(large, ["t", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    posts = posts.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    other = F.expr("transform(sequence(0, blocks - 1), x -> named_struct('i', least(x, block), 'j', greatest(x, block), 'side', if(x = block, 2, if(block < x, 0, 1))))")
    posts = posts.withColumn("p", F.explode(other)).select("t", "key", "p.i", "p.j", "p.side", "blocks", "row", "code")
    spread = F.lit(max(1, m * tables // 16384))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("t", "key"), spread)).otherwise(F.xxhash64("t", "key", "i", "j"))
    met = posts.withColumn("task", task).groupBy("task").applyInPandas(lambda frame: _candidates(frame, b, tables, random, limit), "t int, key int, i int, j int, a bigint, b bigint")
    met = materialize(met)
    both = met.where("a is not null")
    side = lambda s: classes.select(F.col("row").alias(s), F.col("v").alias(f"v{s}"), F.col("rep").alias(f"rep{s}"), F.col("n").alias(f"n{s}"))
    reranked = both.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(_rerank(least, kind), EDGES)
    buckets = met.where("a is null").select("t", "key", "i", "j")
    dense = posts.join(buckets, ["t", "key", "i", "j"]).join(classes, "row")
    return reranked.unionByName(dense.groupBy("t", "key", "i", "j").applyInPandas(lambda frame: _dense(frame, b, tables, least, kind), EDGES))


def _keys(bits: np.ndarray, b: int) -> np.ndarray:
    """A key for each table, from the bits of each code."""
    power = 1 << np.arange(b, dtype=np.int64)
    return (bits.reshape(len(bits), -1, b) @ power).astype(np.int32)


def _unpacked(frame: pd.DataFrame) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(frame["code"]), np.uint8).reshape(len(frame), -1), axis=1)


def _fresh(keys: np.ndarray, t: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that meet in no table before t."""
    for k in range(t):
        new = keys[i, k] != keys[j, k]
        i, j = i[new], j[new]
    return i, j


def _candidates(frame: pd.DataFrame, b: int, tables: int, random: int, limit: int) -> pd.DataFrame:
    """Pairs (a, b) of rows whose codes are near and that meet here first; or the bucket alone where they are too many to be named."""
    bits = _unpacked(frame)
    signs, keys = bits[:, TABLES * b : TABLES * b + random].astype(np.float32) * 2 - 1, _keys(bits[:, : b * tables], b)
    t, key, first, second, side, row = (frame[c].to_numpy() for c in ("t", "key", "i", "j", "side", "row"))
    order = np.lexsort([row, key, t])
    new = (np.diff(t[order]) != 0) | (np.diff(key[order]) != 0)
    out = []
    for at in np.split(order, np.flatnonzero(new) + 1):
        l, r = at[side[at] != 1], at[side[at] != 0]
        if not len(l) or not len(r):
            continue
        near = signs[l] @ signs[r].T >= signs.shape[1] - 2 * limit
        if side[at[0]] == 2:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        i, j = _fresh(keys, int(t[at[0]]), l[i], r[j])
        place = [np.full(1, x[at[0]]) for x in (t, key, first, second)]
        if len(i) > DENSE * len(at) + 1000:
            out.append(pd.DataFrame(dict(zip("t key i j".split(), place)) | {"a": pd.array([None], "Int64"), "b": pd.array([None], "Int64")}))
        elif len(i):
            out.append(pd.DataFrame(dict(zip("t key i j".split(), [np.repeat(x, len(i)) for x in place])) | {"a": pd.array(row[i], "Int64"), "b": pd.array(row[j], "Int64")}))
    return pd.concat(out) if out else pd.DataFrame({c: pd.array([], "Int64") for c in "t key i j a b".split()})


def _rerank(least: float, kind: str):
    """Links among candidate pairs, as rows of EDGES."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col = lambda c: batch.column(batch.schema.get_field_index(c))
            cosine = cosines(scaled(matrix(col("va").to_pylist(), kind)), scaled(matrix(col("vb").to_pylist(), kind)))
            a, b, rep_a, rep_b, n_a, n_b = (col(c).to_numpy()[cosine >= least] for c in ("a", "b", "repa", "repb", "na", "nb"))
            kinds = np.repeat([0, 0, 1], len(a)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.concatenate([a, b, rep_a])), pa.array(np.concatenate([n_b, n_a, rep_b]))], names=["kind", "a", "b"])

    return run


def _dense(frame: pd.DataFrame, b: int, tables: int, least: float, kind: str) -> pd.DataFrame:
    """Links in a bucket, or in two of its blocks, with the vectors at hand; as rows of EDGES."""
    frame = frame.sort_values("row")
    row, side, rep, n = (frame[c].to_numpy() for c in ("row", "side", "rep", "n"))
    keys = _keys(_unpacked(frame)[:, : b * tables], b)
    x = scaled(matrix(frame["v"].tolist(), kind))
    v = x / np.linalg.norm(x, axis=1, keepdims=True)
    l, r = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    product = v[l] @ v[r].T
    near = product >= least
    i, j = np.nonzero(np.abs(product - least) < NEAR_LIMIT)  # rounding could decide here
    near[i, j] = cosines(x[l[i]], x[r[j]]) >= least
    if side[0] == 2:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    i, j = _fresh(keys, int(frame["t"].iloc[0]), l[i], r[j])
    links = np.zeros(len(frame), np.int64)
    np.add.at(links, i, n[j])
    np.add.at(links, j, n[i])
    who = np.flatnonzero(links)
    forest = np.array(_spanning(rep[i], rep[j]), np.int64).reshape(-1, 2)
    kinds = np.repeat([0, 1], [len(who), len(forest)]).astype(np.int32)
    return pd.DataFrame({"kind": kinds, "a": np.concatenate([row[who], forest[:, 0]]), "b": np.concatenate([links[who], forest[:, 1]])})


def _spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each id to the smallest one that the pairs connect it with."""
    names, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = back[: len(a)], back[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return [(int(names[i]), int(names[k])) for i, k in enumerate(label) if i != k]
        label = new


# ---- nearest neighbours

DIMS = 6
#: Probability that a vector nearer than the current k-th would have been met.
SURE = 0.97
LEAF = 128


def chi_square_cdf(x: np.ndarray) -> np.ndarray:
    """Distribution function of chi-square with DIMS (even) degrees of freedom."""
    half, term, total = x / 2, np.ones_like(x), np.zeros_like(x)
    for i in range(DIMS // 2):
        total += term
        term = term * half / (i + 1)
    return 1 - np.exp(-half) * total


def kd_leaves(points: np.ndarray, most: int = LEAF) -> list[np.ndarray]:
    """Leaves of a kd-tree: positions of the points, cut at the median of the widest side."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        at = todo.pop()
        if len(at) <= most:
            out.append(at)
            continue
        p = points[at]
        axis = int(np.argmax(p.max(0) - p.min(0)))
        order = np.argpartition(p[:, axis], len(at) // 2)
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return out


def kd_cuts(points: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """A kd-tree of ``leaves`` (a power of two) cells as (axis, value) for each inner node, in heap order."""
    cuts: list[tuple[int, float]] = []
    level = [points]
    while len(level) < leaves:
        following = []
        for p in level:
            axis = int(np.argmax(p.max(0) - p.min(0))) if len(p) else 0
            value = float(np.median(p[:, axis])) if len(p) else 0.0
            cuts.append((axis, value))
            following += [p[p[:, axis] < value], p[p[:, axis] >= value]]
        level = following
    return cuts


def cell_of(points: np.ndarray, cuts: list[tuple[int, float]]) -> np.ndarray:
    axis, value = np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts])
    node = np.zeros(len(points), np.int64)
    for _ in range((len(cuts) + 1).bit_length() - 1):
        node = 2 * node + 1 + (points[np.arange(len(points)), axis[node]] >= value[node])
    return node - len(cuts)


def box_gap(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        x = points[:, d, None]
        out += np.maximum(0, np.maximum(low[None, :, d] - x, x - high[None, :, d])) ** 2
    return out


def stable_projection(x: np.ndarray, norm: float | None) -> np.ndarray:
    """Gaussian projections to DIMS dimensions; data (with the largest norm given) get one more component, which
    makes the largest inner product the nearest point, queries a zero there."""
    turn = np.random.default_rng(11).normal(size=(x.shape[1] + 1, DIMS))
    if norm is None:
        return x @ turn[:-1]
    return np.column_stack([x, np.sqrt(np.maximum(0, norm**2 - (x**2).sum(1)))]) @ turn


def _search(queries: np.ndarray, bound: np.ndarray, own: np.ndarray, data: np.ndarray, norm: float, k: int) -> list[np.ndarray]:
    """For each query the positions in ``data`` (different vectors) of all that reach its k-th best score, and its bound.

    ``own`` names the data that a query must not meet (-1: none).
    """
    points, asked = stable_projection(data, norm), stable_projection(queries, None)
    leaves = kd_leaves(points)
    gap = box_gap(asked, np.array([points[x].min(0) for x in leaves]), np.array([points[x].max(0) for x in leaves]))
    order = np.argsort(gap, axis=1, kind="stable")
    square = (queries**2).sum(1) + norm**2
    best = np.repeat(bound[:, None], k, axis=1)
    slack = 1e-9 * norm * np.linalg.norm(queries, axis=1)  # rounding must part no ties; exact scores decide later
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    active = np.arange(len(queries))
    step = 0
    while step < len(leaves) and len(active):
        # each step takes twice as many leaves as the one before; the test is made for each leaf with what is known before the step
        order_, gap_ = order[active, step : 2 * step + 1], np.take_along_axis(gap[active], order[active, step : 2 * step + 1], 1)
        go = ~left_out(gap_, (square[active] - 2 * best[active].min(1))[:, None])
        who, leaf_of = np.nonzero(go)
        who, leaf_of = active[who], order_[go]
        active, step = active[go[:, -1]], 2 * step + 1
        by = np.argsort(leaf_of, kind="stable")
        for at in np.split(by, np.flatnonzero(np.diff(leaf_of[by])) + 1):
            if not len(at):
                continue
            q, leaf = who[at], leaves[leaf_of[at[0]]]
            got = queries[q] @ data[leaf].T
            got[own[q][:, None] == leaf[None, :]] = -np.inf
            hit = np.flatnonzero(got.max(1) >= best[q].min(1) - slack[q])
            if len(hit):
                q, got = q[hit], got[hit]
                best[q] = -np.partition(-np.hstack([best[q], got]), k - 1, axis=1)[:, :k]
                i, j = np.nonzero((got >= (best[q].min(1) - slack[q])[:, None]) & (got > -np.inf))
                found.append((q[i], leaf[j], got[i, j]))
    who, place, score = (np.concatenate(c) for c in zip(*found))
    keep = score >= best[who].min(1) - slack[who]
    who, place = who[keep], place[keep]
    order = np.argsort(who, kind="stable")
    return np.split(place[order], np.searchsorted(who[order], np.arange(1, len(queries))))


def left_out(gap: np.ndarray, kth: np.ndarray) -> np.ndarray:
    """The stopping test: would a vector nearer than the k-th (squared distance) have been met before this squared gap?"""
    return chi_square_cdf(gap / np.maximum(1e-300, kth)) >= SURE


def products(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products added up in order of the components, so equal vectors have equal scores wherever they stand."""
    out = np.zeros(len(rows))
    for i in range(rows.shape[1]):
        out += rows[:, i] * x[i]
    return out


def _block(frame: pd.DataFrame, norm: float, k: int, kind: str) -> pd.DataFrame:
    """The k best of a block's data for each of its queries."""
    asks = frame["query_id"].notna().to_numpy()
    q, d = np.flatnonzero(asks), np.flatnonzero(~asks)
    out = []
    if len(q) and len(d):
        v = matrix(frame["v"].tolist(), kind)
        query, bound = frame["query_id"].to_numpy()[q].astype(np.int64), frame["bound"].to_numpy(float)[q]
        ids = [np.asarray(x, np.int64) for x in frame["ids"].to_numpy()[d]]
        lone = {int(x[0]): i for i, x in enumerate(ids) if len(x) == 1}  # a vector with no other id than the query's is not met
        own = np.array([lone.get(int(i), -1) for i in query])
        for at in range(0, len(q), 512):
            z = min(len(q), at + 512)
            for i, place in zip(range(at, z), _search(v[q[at:z]], bound[at:z], own[at:z], v[d], norm, k)):
                if len(place):
                    near = [ids[u][ids[u] != query[i]][:k] for u in place]
                    score = np.repeat(products(v[d[place]], v[q[i]]), [len(x) for x in near])
                    near = np.concatenate(near)
                    top = np.lexsort((near, -score))[:k]
                    out.append((np.full(len(top), query[i]), near[top], score[top]))
    cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pd.DataFrame({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})


def _met(data: DataFrame, asked: DataFrame, norm: float, k: int, kind: str, data_block: int, query_block: int) -> DataFrame:
    """Rows (query_id, vec_id, score): queries (query_id, v, bound, cell) against the data (v, ids, cell) of their cells."""
    parts = data.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / data_block).alias("parts"))
    turns = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / query_block).alias("turns"))
    plan = F.broadcast(parts.join(turns, "cell"))  # a row for each cell, of which there are CUT_SAMPLE / 16 at most
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = data.join(plan, "cell").select(F.lit(None).cast("long").alias("query_id"), "v", "ids", F.lit(None).cast("double").alias("bound"), "cell", F.pmod(F.xxhash64("v"), F.col("parts")).alias("part"), upto("turns").alias("turn"))
    right = asked.join(plan, "cell").select("query_id", "v", F.lit(None).cast("array<bigint>").alias("ids"), "bound", "cell", upto("parts").alias("part"), F.pmod(F.xxhash64("query_id", "v"), F.col("turns")).alias("turn"))
    return left.unionByName(right).groupBy("cell", "part", "turn").applyInPandas(lambda frame: _block(frame, norm, k, kind), "query_id bigint, vec_id bigint, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(rows: DataFrame, k: int = 20, every: int = 20, cell_rows: int = 4096, first: int = 4, data_block: int = 8192, query_block: int = 1024) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k largest inner products found for each query.

    Queries are the rows whose id is divisible by ``every``. The data's stable (Gaussian) projections to
    DIMS dimensions are indexed by a kd-tree (Sun et al., SRS), whose upper levels are cells of
    the whole table, cut by a sample, and whose lower levels stand in each task. A query is verified in its
    ``first`` nearest cells; with the k-th score found there it goes on to those cells only that the chi-square test leaves open,
    that is where a nearer vector would not yet have been met with probability SURE. In a cell, leaves are visited in ascending
    distance and verified with the original vectors until the same test holds.
    """
    kind = item_type(rows)
    good = usable(rows).where("v is not null")

    def largest(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([float(np.linalg.norm(matrix(batch.column(0).to_pylist(), kind), axis=1).max())])], names=["norm"])

    top = good.select("v").mapInArrow(largest, "norm double").agg(F.max("norm")).first()[0] or 1.0
    n = good.count()
    sample = _sample(good, n, CUT_SAMPLE, kind)
    cells = 1 << max(0, min(n // cell_rows, len(sample) // 16, CUT_SAMPLE // 16).bit_length() - 1)
    cuts = kd_cuts(stable_projection(sample, top), cells) if cells > 1 else []

    def placed(batches):
        for batch in batches:
            if batch.num_rows:
                # copies in a batch become one row with the smallest ids
                ids, values = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object)
                order = np.argsort(ids, kind="stable")
                same, names = pd.factorize(values[order])
                own = np.split(ids[order][np.argsort(same, kind="stable")], np.cumsum(np.bincount(same))[:-1])
                points = stable_projection(matrix(list(names), kind), top)
                yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.binary()), pa.array([x[: k + 1] for x in own], pa.list_(pa.int64())), pa.array(cell_of(points, cuts)), pa.array(list(points), pa.list_(pa.float64()))], names=["v", "ids", "cell", "point"])

    smallest = F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1)
    data = good.mapInArrow(placed, "v binary, ids array<bigint>, cell bigint, point array<double>").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    for key in (["v", "cell", "point", "salt"], ["v", "cell", "point"]):  # ids of a frequent vector come together in two steps
        data = data.groupBy(*key).agg(smallest.alias("ids"))
    data = materialize(data)
    box = data.groupBy("cell").agg(*(F.min(F.col("point")[d]).alias(f"l{d}") for d in range(DIMS)), *(F.max(F.col("point")[d]).alias(f"h{d}") for d in range(DIMS))).orderBy("cell").collect()  # a row a cell
    low, high = (np.array([[r[f"{side}{d}"] for d in range(DIMS)] for r in box]).reshape(-1, DIMS) for side in "lh")
    names = np.array([r["cell"] for r in box], np.int64)
    data = data.select("v", "ids", "cell")

    def routed(chosen):
        """Queries in the cells that ``chosen`` picks from their gaps, nearest cells first, and bounds."""

        def run(batches):
            for batch in batches:
                if batch.num_rows and len(names):
                    x, bound = matrix(batch.column(1).to_pylist(), kind), batch.column(2).to_numpy(zero_copy_only=False)
                    gap = box_gap(stable_projection(x, None), low, high)
                    order = np.argsort(gap, axis=1, kind="stable")
                    i, j = np.nonzero(chosen(np.take_along_axis(gap, order, 1), (x**2).sum(1) + top**2 - 2 * bound))
                    at = pa.array(i)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(names[order[i, j]])], names=["query_id", "v", "bound", "cell"])

        return run

    kinds = "query_id bigint, v binary, bound double, cell bigint"
    asked = good.where(F.col("vec_id") % every == 0).distinct().select(F.col("vec_id").alias("query_id"), "v", F.lit(float("-inf")).alias("bound"))
    nearby = asked.mapInArrow(routed(lambda gap, _: np.broadcast_to(np.arange(gap.shape[1]) < first, gap.shape)), kinds)
    begun = materialize(_ranked(_met(data, nearby, top, k, kind, data_block, query_block), k))
    if cells > first:
        bounds = begun.where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
        again = asked.drop("bound").join(bounds, "query_id", "left").select("query_id", "v", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
        rest = materialize(again.mapInArrow(routed(lambda gap, kth: (np.arange(gap.shape[1]) >= first) & ~left_out(gap, kth[:, None])), kinds))
        begun = _ranked(begun.drop("rank").unionByName(_met(data, rest, top, k, kind, data_block, query_block)), k)
    return begun.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
