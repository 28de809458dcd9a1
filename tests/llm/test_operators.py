"""The llm operators on awkward tables, and against brute force."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from grainmill.llm import language, mixing, neardup, packing, registry, sharding, token_counts, token_store, vectors, warc
from grainmill.llm.library_tokens import piece_table
from grainmill.llm.pieces import eased, frugal
from tests.compare import same_rows, tables
from tests.conftest import SF

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with the operators' own names.
CLASH = ["size", "label", "grp", "rep", "target", "source_size", "n_copies", "row", "col", "copy", "score", "lang_pred", "kept", "component_id", "b", "node", "rows"]
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 9)) for _ in range(n))


def awkward():
    """Nulls, empty and very long texts, repeated rows, ties, control characters, special strings."""
    base = words(60, 1)
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, base, "en", "a"), (5, base, "de", "b"), (5, base, "de", "b"), (6, base.upper(), "en", "é"),
        (None, base, "en", None), (None, None, None, None), (7, words(200_000, 2), "en", "a"), (8, "one two", "fr", "b"), (9, "one two", "fr", "c"), (10, "12 34 !!", "fr", "c"),
        (11, "x<|endoftext|>y <|startoftext|> don't  'll \r\n\x1c 漢字 é", "es", "c"), (12, base + " tail", "en", "a"), (13, "two one", "fr", None),
    ]
    return [(i, t, l, s, len(t or "")) for i, t, l, s in rows]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(awkward(), DOC).repartition(3)
    return df.withColumns({c: F.lit(f"x{i}") for i, c in enumerate(CLASH)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, con, name):
    same_rows(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name])


# ---- 1


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def brute_groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        k = len(sets[a] & sets[b])
        if k and 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates_awkward(odd, empty):
    got = neardup.near_duplicates(odd).collect()
    want = brute_groups([(r[0], r[1]) for r in awkward() if r[0] is not None])
    assert len(got) == len(awkward())
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"] is None
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (*want[r["doc_id"]], want[r["doc_id"]][1] == r["doc_id"])
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicate_blocks(spark, monkeypatch):
    """A group larger than a block, with links at and below the threshold, is split and still whole."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    r, base = random.Random(5), words(120, 9).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"edit{r.randint(0, 400)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, words(40, 100 + i)) for i in range(20)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)


def _window_chain(n, step, width=40):
    """Texts that slide over one long text: each is like the next few, the ends have nothing in common."""
    w = [f"w{i}" for i in range(n * step + width)]
    return [(i, " ".join(w[i * step : i * step + width])) for i in range(n)]


def test_near_duplicate_chain_is_not_compared_whole(spark, monkeypatch):
    """A chain of documents is one component, found without comparing each with each."""
    pairs, inner, n = [], neardup.list_links, 4000

    def counted(docs, members, *rest):
        pairs.append(members.groupBy("head").count().agg(F.sum(F.col("count") ** 2)).first()[0] or 0)
        return inner(docs, members, *rest)

    monkeypatch.setattr(neardup, "list_links", counted)
    docs = spark.createDataFrame(_window_chain(n, 3), "doc_id long, text string").repartition(4)
    got = {r["component_id"]: r["n"] for r in neardup.near_duplicates(docs).groupBy("component_id").agg(F.count("*").alias("n")).collect()}
    assert got == {0: n} and 0 < pairs[0] < n * 400


def test_near_duplicates_below_and_at_the_threshold(spark):
    """Clusters whose members are not all like one head; texts that share an id; all as brute force."""
    r, rows = random.Random(8), []
    for c in range(12):
        base = words(80, 300 + c).split()
        for i in range(25):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = f"edit{r.randint(0, 99)}"
            rows.append((1000 * c + i, " ".join(w)))
    rows += [(20_000 + i, t) for i, t in _window_chain(120, 2)]
    want = brute_groups(rows)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    a, b = words(50, 71), words(50, 72)
    twice = [(1, a), (2, b), (5, a + " x"), (5, b + " y"), (5, b + " y"), (9, "other words of no use here at all")]
    rows = neardup.near_duplicates(spark.createDataFrame(twice, "doc_id long, text string")).collect()
    assert {(x["doc_id"], x["component_id"]) for x in rows} == {(1, 1), (2, 1), (5, 1), (9, 9)} and len(rows) == 6


def test_overlaps_counts_frequent_and_rare_values():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 90, r.integers(1, 60)).astype(np.uint64)) for _ in range(90)]
    got = neardup.overlaps(sets[:40], sets[40:], dense_from=20)
    assert (got == np.array([[len(np.intersect1d(a, b)) for b in sets[40:]] for a in sets[:40]])).all()


# ---- 2, 3, 8


def encoded(name, rows, end):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path(name))
    return [(i, tok.encode(t or "", add_special_tokens=False).ids + end) for i, t in rows]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_token_store_round_trip(odd, empty):
    got = token_store.token_store(odd, P.path("byte_bpe_50k.json")).collect()
    rows = sorted(((r[0], r[1]) for r in awkward()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for i, ids in encoded("byte_bpe_50k.json", rows, [2]):
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_store.token_store(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_store_gives_ids_and_compresses(spark, sf):
    from grainmill.llm.common import shared_dir

    docs, path = spark.read.parquet(f"{sf}/documents.parquet"), shared_dir(spark)
    token_store.write_store(docs, P.path("byte_bpe_50k.json"), 2, path, shard_ids=20_000)
    want = dict(encoded("byte_bpe_50k.json", [(r["doc_id"], r["text"]) for r in docs.collect()], [2]))
    assert {r["doc_id"]: list(r["ids"]) for r in token_store.read_store(spark, path).collect()} == want
    heads = spark.read.parquet(path).select("seq", "n_ids", (F.octet_length("symbols") / 4).alias("n")).collect()
    assert len(heads) > 1 and sum(h["n"] for h in heads) < 0.8 * sum(h["n_ids"] for h in heads)


@pytest.mark.parametrize("seed", range(6))
def test_re_pair_round_trip(seed):
    r = np.random.default_rng(seed)
    n = r.integers(0, 60, 30)
    ids = r.integers(0, 2 + 4 * seed, n.sum()).astype(np.int32)
    sym, per_doc, rules, lengths = token_store.compress(ids, n, 1000, least=2, uses=1)
    back, width = token_store.decompress(sym, rules, lengths, 1000)
    assert (back == ids).all() and per_doc.sum() == len(sym)
    first = np.concatenate([[0], np.cumsum(per_doc)]).astype(int)
    for d in range(len(n)):  # a document from its own symbols alone
        some, _ = token_store.decompress(sym[first[d] : first[d + 1]], rules, lengths, 1000)
        assert (some == ids[n[:d].sum() : n[: d + 1].sum()]).all()


@pytest.mark.parametrize("seed", range(4))
def test_re_pair_leaves_no_frequent_pair(seed):
    """With the production minimum: passages that repeat, long runs of one id, and text-like ids."""
    r = np.random.default_rng(seed)
    parts = [np.tile(r.integers(0, 5000, 512), 60), np.full(3000, 7), np.tile([1, 2, 1], 500), (r.zipf(1.3, 30_000) % 4000)]
    n = np.array([len(p) for p in parts])
    ids = np.concatenate(parts).astype(np.int32)
    sym, per_doc, rules, lengths = token_store.compress(ids, n, 1 << 17)
    back, _ = token_store.decompress(sym, rules, lengths, 1 << 17)
    assert (back == ids).all()
    owner = np.repeat(np.arange(4), per_doc)
    pairs = collections.Counter(zip(sym[:-1][owner[:-1] == owner[1:]].tolist(), sym[1:][owner[:-1] == owner[1:]].tolist()))
    assert max(pairs.values()) < token_store.LEAST
    assert per_doc[0] <= 60 and per_doc[1] < 40 and lengths.max() >= 512


def test_store_decodes_single_documents_and_ranges(spark, sf):
    from grainmill.llm.common import shared_dir

    docs, path = spark.read.parquet(f"{sf}/documents.parquet"), shared_dir(spark)
    token_store.write_store(docs, P.path("byte_bpe_50k.json"), 2, path, shard_ids=20_000)
    want = dict(encoded("byte_bpe_50k.json", [(r["doc_id"], r["text"]) for r in docs.collect()], [2]))
    some = sorted(want, key=lambda i: len(want[i]))[-3:] + [0]
    assert {r["doc_id"]: list(r["ids"]) for r in token_store.read_ids(spark, path, some).collect()} == {i: want[i] for i in some}
    for start, length in ((0, 5), (17, 40), (1000, 333), (10**6, 2)):
        got = {r["doc_id"]: list(r["ids"]) for r in token_store.read_ids(spark, path, some, start, length).collect()}
        assert got == {i: want[i][start : start + length] for i in some}
    assert token_store.read_ids(spark, path, []).count() == 0


def test_token_counts(odd, empty):
    got = token_counts.token_counts(odd, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    want = collections.Counter((i, len((t or "").encode()), len(ids), len(ids) > 512) for (i, ids), t in zip(encoded("byte_bpe_50k.json", [(r[0], r[1]) for r in awkward()], []), [r[1] for r in awkward()]))
    assert collections.Counter(map(tuple, got)) == want
    assert token_counts.token_counts(empty, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_token_counts_of_random_texts(spark):
    alpha = ["a", "the", "don't", "'s", "'", "''s", " ", "  ", "\n", "\n\n", " \n", "\t", "é", "é", "É", "İ", " ", " ", "。", "漢字", "12", "½", ".", "!?", "-", '"', "<|endoftext|>", "<|", "_", "\x1c", "\x85", "😀", "\r\n", "'ll", "'LL", " '", "aaaa"]
    r = random.Random(3)
    rows = [(i, "".join(r.choice(alpha) for _ in range(r.randint(0, 40)))) for i in range(600)]
    got = {x["doc_id"]: x["n_tokens"] for x in token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), P.path("byte_bpe_50k.json"), P.PATTERN).collect()}
    assert got == {i: len(ids) for i, ids in encoded("byte_bpe_50k.json", rows, [])}


def _twins(n):
    """Two texts that every polynomial hash modulo 2**64 takes for one: the Thue-Morse word and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_unbroken_texts_cost_about_their_length():
    import time

    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    model, library = token_counts.MergeModel(path), Tokenizer.from_file(path)
    r = random.Random(4)
    texts = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n)) for n in (513, 600, 5000, 1_000_000)] + ["a" * 100_001, "ab" * 30_000, "thethe" * 5000, "x" * 512]
    for text in texts:
        began = time.perf_counter()
        assert model.counts([text.encode(), b"the"]).tolist() == [len(library.encode(text, add_special_tokens=False).ids), 1]
        assert time.perf_counter() - began < 40


def test_crafted_and_long_texts(spark):
    one, two = _twins(4096)
    rows = [(1, one), (2, two), (3, f"{one} {two}"), (4, "x" * 1_300_000), (5, "漢" * 600_000), (6, "y " * 700_000), (7, two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = dict(encoded("byte_bpe_50k.json", rows, []))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect()}
    assert got == {i: len(x) for i, x in want.items()}
    table = token_store.piece_table(P.path("byte_bpe_50k.json"))
    for i, text in rows[:3]:
        assert table.ids([text.encode()])[0].tolist() == want[i]
    assert not set(neardup.shingle_sets([one.encode()])[0]) & set(neardup.shingle_sets([two.encode()])[0])


def test_equal_hashes_do_not_mix_pieces(monkeypatch):
    from grainmill.llm import pieces

    real = pieces.hashes
    monkeypatch.setattr(pieces, "hashes", lambda data, start, stop: np.where(stop - start > 7, np.uint64(2**63), real(data, start, stop)))
    table = pieces.PieceTable(pieces.word_level_cuts, lambda parts: (np.array([2] * len(parts)), np.array([x for p in parts for x in (len(p), sum(p))], np.int32)), limit=4)
    texts = [x.replace(b"a", b"a" * 9).replace(b"b", b"b" * 9) for x in (b"aa bb c", b"ddddd aa", b"", b"bb aa ddddd e")]
    ids, n = table.ids(texts)
    want = [x for t in texts for p in re.findall(rb"\s+|\S+", t) for x in (len(p), sum(p))]
    assert ids.tolist() == want and n.tolist() == [10, 6, 0, 14]


def check_packing(got, want_rows, capacity=4096):
    want = collections.Counter()
    for i, ids in encoded("word_bpe_49k.json", want_rows, [1]):
        for k, a in enumerate(range(0, len(ids), capacity)):
            want[(i, k, a, len(ids[a : a + capacity]), crc(ids[a : a + capacity]))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, odd, empty, sf):
    check_packing(packing.packed_documents(odd, P.path("word_bpe_49k.json")).collect(), [(r[0], r[1]) for r in awkward()])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.packed_documents(docs, P.path("word_bpe_49k.json")).collect()
    bins = check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert bins <= -(-sum(r["length"] for r in rows) // 4096) + 1
    assert packing.packed_documents(empty, P.path("word_bpe_49k.json")).count() == 0


def test_copies_spread_over_packing_groups(spark):
    rows = [(i, "the same text" if i % 3 else words(5, i)) for i in range(3000)]
    got = packing.packed_documents(spark.createDataFrame(rows, "doc_id long, text string"), P.path("word_bpe_49k.json"), group_rows=300).collect()
    check_packing(got, rows)
    size = collections.Counter(r["sequence_id"] >> 40 for r in got)
    assert len(size) == 10 and max(size.values()) < 400


def test_local_search_frees_bins():
    length = np.array([6, 4, 5, 5, 3, 3, 4, 7, 3])
    bins = packing.local_search([[0], [1], [2], [3], [4, 5], [6], [7], [8]], length, 10)
    assert sorted(i for b in bins for i in b) == list(range(9)) and len(bins) == 4
    assert all(length[b].sum() <= 10 for b in bins)


def test_local_search_makes_the_packing():
    """Bins before and after the search, for texts of usual and of middling lengths."""
    r = np.random.default_rng(0)
    for length, most in ((np.clip(r.lognormal(5.5, 1.0, 8000).astype(int) + 1, 1, 4096), 1.001), (r.integers(1300, 2600, 3000), 1.025)):
        first = packing.first_bins(length, 4096)
        bins = packing.local_search(first, length, 4096)
        print("bins", len(first), "after the search", len(bins), "at least", -(-length.sum() // 4096))
        assert len(bins) < len(first) and len(bins) <= most * -(-length.sum() // 4096) + 1


def test_local_search_leaves_no_step():
    length = np.random.default_rng(3).integers(1300, 2600, 500)
    first = packing.first_bins(length, 4096)
    bins = packing.local_search(first, length, 4096)
    assert sorted(i for b in bins for i in b) == list(range(500))
    fill = [int(length[b].sum()) for b in bins]
    assert max(fill) <= 4096 and len(bins) <= len(first)
    some = lambda b, most: [sum(c) for n in range(most + 1) for c in itertools.combinations(length[b].tolist(), n)]
    for a, b in itertools.permutations(range(len(bins)), 2):
        if fill[a] < 4096 and fill[b] < 4096:
            best = [x - y for x in some(bins[a], 1) for y in some(bins[b], 2)] + [x - y for x in some(bins[a], 2) for y in some(bins[b], 1)[1:]]
            assert not any(max(0, fill[a] - fill[b]) < g <= 4096 - fill[b] for g in best)


# ---- 4, 10


def test_vectors_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [0.0, 1.0]), (None, [1.0, 0.0]), (10, [-1.0, 0.0]), (20, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("keys", "row", "score", "a", "component", "n_links")})
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[20] == (2, 1, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)) and got[None] == (0, None, None)
    near = vectors.nearest(df).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in near] == [(20, 1, 2), (20, 2, 1), (20, 3, 9), (20, 4, 10)]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_vectors(none).count() == 0 and vectors.nearest(none).count() == 0


@pytest.mark.parametrize("dense", [None, -1.0])
def test_huge_and_tiny_vectors(spark, monkeypatch, dense):
    if dense is not None:
        monkeypatch.setattr(vectors, "DENSE", dense)
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=4).tolist()) for i in range(28)] + [(100, [1e-200, 0.0, 0.0, 0.0]), (101, [1e200, 1e190, 0.0, 0.0]), (102, [1e200, 0.0, 0.0, 0.0]), (103, [5e-324, 0.0, 0.0, 0.0]), (104, [0.0, 0.0, -1.7e308, 1e308])]
    rows += [(200, [1.0, 0.0, 0.0, 0.0]), (201, [0.9, 0.19**0.5, 0.0, 0.0]), (202, [9e150, 0.19**0.5 * 1e151, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in vectors.near_vectors(df).collect()}
    x = vectors.scaled(np.array([v for _, v in rows]))
    ids = [i for i, _ in rows]
    for a, i in enumerate(ids):
        assert got[i][0] == sum(vectors.cosines(x[a : a + 1], x[b : b + 1])[0] >= 0.9 for b in range(len(ids)) if b != a), i
    assert len({got[i][1] for i in (100, 101, 102, 103, 200)}) == 1


def test_overlaps_of_large_sets_are_not_rounded():
    both, left, right = 671_091, 111_848, 111_849  # exactly 75 percent
    x, y = np.arange(both + left, dtype=np.uint64), np.append(np.arange(both, dtype=np.uint64), np.arange(10**7, 10**7 + right, dtype=np.uint64))
    assert 100 * both == 75 * (both + left + right) and neardup._alike([x], [y], 75).all()
    assert not neardup._alike([x], [np.append(y, np.uint64(10**8))], 75).any()


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 64)
    r = np.random.default_rng(4)
    x = r.normal(size=(1200, 32)).astype(np.float32)
    x[:300] = x[0] + 0.05 * r.normal(size=(300, 32))  # a hot group, larger than a block
    x[300:400] = x[400:500] + 0.25 * r.normal(size=(100, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    d = x.astype(float)
    cos = d @ d.T / np.outer(np.linalg.norm(d, axis=1), np.linalg.norm(d, axis=1))
    want = (cos >= 0.9).sum(1) - 1
    got = np.array([r["n_links"] for r in vectors.near_vectors(df).orderBy("vec_id").collect()])
    assert (got <= want).all() and got.sum() >= 0.95 * want.sum()
    near = vectors.nearest(df, k=10, every=50, cell_rows=60, first=2, data_block=50, query_block=5).collect()
    assert len(vectors.nearest(df, k=10, every=50).collect()) == 240
    ip = d @ d.T
    hit = 0
    for q in range(0, 1200, 50):
        ip[q, q] = -np.inf
        hit += len({r["vec_id"] for r in near if r["query_id"] == q} & set(np.argsort(-ip[q], kind="stable")[:10].tolist()))
    assert len(near) == 240 and hit >= 0.9 * 240


# ---- 5


def test_nearest_ties_go_to_smaller_ids(spark):
    rows = [(i, [2.0, 0.0, 0.0] if i % 2 else [0.0, 2.0, 0.0]) for i in range(1, 600)] + [(1000, [1.0, 1.0, 0.0])] + [(i, [0.1, 0.1, 1.0]) for i in range(1001, 1200)]
    df = spark.createDataFrame(rows[::-1], "vec_id long, embedding array<double>")
    got = vectors.nearest(df, k=5, every=100).where("query_id in (100, 1000)").orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(100, i, 4.0) for i in (2, 4, 6, 8, 10)] + [(1000, i, 2.0) for i in (1, 2, 3, 4, 5)]


@pytest.mark.parametrize("bits", [10, 13, 16])
def test_near_vectors_with_the_keys_of_large_tables(spark, monkeypatch, bits):
    monkeypatch.setattr(vectors, "table_bits", lambda n: bits)  # 16: the keys of 17 million vectors
    r = np.random.default_rng(5)
    a, u = r.normal(size=(2, 1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    u -= (u * a).sum(1, keepdims=True) * a
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    b = 0.902 * a + np.sqrt(1 - 0.902**2) * u
    x = np.vstack([a, b])
    want = np.triu(x @ x.T >= 0.9, 1).sum()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vectors.near_vectors(df).agg(F.sum("n_links")).first()[0] / 2
    print("links found", got, "of", want)
    assert want >= 1500 and 0.98 * want <= got <= want


def test_dense_buckets_and_copies(spark, monkeypatch):
    monkeypatch.setattr(vectors, "DENSE", -20)  # buckets with candidates fetch their vectors
    monkeypatch.setattr(vectors, "BLOCK", 50)
    r = np.random.default_rng(6)
    x = np.repeat(r.normal(size=(90, 16)), 4, axis=0)
    x[100:220] = x[100] + 0.1 * r.normal(size=(120, 16))
    want = (x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= 0.9).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {y["vec_id"]: (y["n_links"], y["component_id"]) for y in vectors.near_vectors(df).collect()}
    assert sum(n for n, _ in got.values()) >= 0.98 * want.sum() and all(got[i][0] <= want[i] for i in got)
    assert got[0] == (3, 0) and got[3] == (3, 0)


def test_language(spark, odd, empty, sf):
    docs = spark.read.parquet(f"{sf[:-5]}0.01/documents.parquet")
    got = language.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(1000) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    weird = collections.Counter((r["doc_id"], r["lang_pred"]) for r in language.identified(odd).collect())
    for i in (1, 2, 3, 10):
        assert weird[(i, "und")] == 1
    assert language.identified(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "hello", None, None, 5)], DOC)
    assert [(r["lang_pred"], r["score"]) for r in language.identified(unlabelled).collect()] == [("und", 0.0)]


def test_language_of_long_texts_and_rare_languages(spark, monkeypatch, sf):
    docs = spark.read.parquet(f"{sf[:-5]}0.01/documents.parquet")
    model = language.fit(docs)
    texts = [r["text"] for r in docs.where("text is not null").limit(40).collect()]
    texts = ["", *texts, " ".join(texts), "½ 12"]
    alone = np.concatenate([model.scores([t]) for t in texts])
    monkeypatch.setattr(language, "STRETCH", 100)  # texts are cut often, at any place, and stand beside one another
    np.testing.assert_allclose(model.scores(texts), alone, atol=1e-4)
    np.testing.assert_allclose(language.features(texts[1:4]).sum(1), 4, rtol=1e-4)
    rare = docs.withColumn("lang", F.when(F.col("doc_id") == 0, "xx").otherwise(F.col("lang")))
    assert {r["lang"] for r in language.training_rows(rare, 40).collect()} == {"xx", "en", "de", "fr", "es"}
    assert language._predictions(["½ 12", None, "ab"], model)[0][:2] == ["und", "und"]


def test_samples_of_huge_tables_are_not_empty(spark):
    from grainmill.llm.common import drawn

    ids = spark.range(1_000_000)
    assert 300 < ids.where(drawn([F.col("id")], "s", 5e-4)).count() < 700
    assert ids.where(drawn([F.col("id")], "s", 1.0)).count() == 1_000_000
    text = str(drawn([F.col("id")], "s", 2000 / 1e12))  # the threshold of a sample of 2,000 of a trillion rows
    assert text and int((1 << 62) * 2000 / 1e12) > 1e9


# ---- 6


def test_warc_awkward(spark):
    long_ = "<p>" + "é漢x" * 50_000
    rows = [(1, "u", None), (2, None, ""), (3, "u v\nw", "x" * 99), (4, "u", "x" * 99), (5, "u", long_), (6, "u", long_), (7, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" + "y" * 200), (8, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" + "y" * 200), (None, "u", long_), (5, "u", long_)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("payload", "record", "n", "first")}).repartition(2)
    got = collections.Counter(tuple(r) for r in warc.archived_pages(df, segment_bytes=1000).collect())
    want = collections.Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        first = min((j for j, _, g in rows if (g or "") == (h or "") and j is not None), default=None)
        ref = first if len(raw) >= 100 and first is not None and first != i else None
        want[(i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if ref is None else "revisit", ref)] += 1
    assert got == want
    assert warc.archived_pages(df.limit(0)).count() == 0


def test_warc_missing_segment(spark):
    df = spark.createDataFrame([(1, "u", "z" * 5000)], "page_id long, url string, html string")
    from grainmill.llm.common import shared_dir

    path = shared_dir(spark)
    warc.write_archives(df, path, segment_bytes=1000)
    rows = warc.read_records(spark, path)
    with pytest.raises(Exception, match="lacks a segment"):
        warc.reassembled(rows.where("segment is null or segment <> 2")).collect()


def test_warc_references_and_files(spark):
    """References are ids of records; files end by bytes whatever the size of a page, and are read as streams."""
    import glob
    import gzip
    import io

    from grainmill.llm.common import shared_dir

    big = "".join(chr(97 + i % 26) for i in range(1_000_000))
    rows = [(i, "u", big + str(i // 2)) for i in range(40)] + [(100, "u", "s" * 200), (100, "u", "s" * 200), (101, "u", "s" * 200), (102, "u", "t" * 200), (102, "u", "v" * 200), (103, "u", "t" * 200)]
    path = shared_dir(spark)
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path, file_bytes=4 << 20)
    files = [gzip.open(f).read() for f in glob.glob(path.removeprefix("file:") + "/part-*")]
    assert len(files) >= 5 and max(map(len, files)) <= 4 << 20
    fields = [f for content in files for f, _ in warc.records(io.BytesIO(content))]
    ids = [f["WARC-Record-ID"] for f in fields]
    assert len(set(ids)) == len(ids)
    revisits = [f for f in fields if f["WARC-Type"] == "revisit"]
    assert len(revisits) == 20 + 1 + 1
    for f in revisits:
        refers = f.get("WARC-Refers-To")
        assert (refers is None) == (f["Page-Refers-To"] == "100")  # rows 100 repeat: none of them is the one
        assert refers is None or (refers in ids and refers.startswith(f"<urn:page:{f['Page-Refers-To']}:"))
    got = warc.reassembled(warc.read_records(spark, path)).collect()
    assert collections.Counter((r["page_id"], r["payload_bytes"]) for r in got) == collections.Counter((i, len(h)) for i, _, h in rows)


def test_warc_batches_are_bounded():
    """A reader's rows and a writer's records go on by bytes: 200 MB of records never lie in one batch."""
    sizes = [sum(map(len, out)) for out in warc._bounded((b"x" * 32_768 for _ in range(6_400)), len, list)]
    assert sum(sizes) == 6_400 * 32_768 and max(sizes) <= warc.BATCH_BYTES + 32_768


def test_chunks():
    for n in (0, 1, 8192, 8193, 50_000):
        assert warc.unchunked(warc.chunked(b"q" * n)) == b"q" * n


# ---- 7, 9


def test_shards(spark, odd, empty):
    got = sharding.shards_by_bytes(odd, 4).collect()
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 16, None if r[1] is None else zlib.crc32(r[1].encode())) for r in awkward())
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    _slots(got)
    assert sharding.shards_by_bytes(empty, 4).count() == 0


def _slots(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards_are_even_and_keep_groups(spark):
    rows = [(i, words(30, i % 1500)) for i in range(3000)] + [(5000 + i, words(40, -1)) for i in range(1500)]
    got = sharding.shards_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    size, where = collections.Counter(), collections.defaultdict(set)
    for r in got:
        size[r["shard"]] += r["size"]
        where[r["text_crc32"]].add(r["shard"])
    _slots(got)
    assert max(size.values()) <= 1.02 * sum(size.values()) / 8
    assert sum(len(v) > 1 for v in where.values()) < 0.5 * len(where)  # at random, 7 of 8 pairs are cut


def test_shards_keep_pairs(spark):
    rows = [(i, words(30, i % 1500)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    at_random = docs.groupBy("text").agg(F.count_distinct(F.pmod(F.xxhash64("doc_id", F.xxhash64("text", F.octet_length("text"))), F.lit(8))).alias("k")).where("k > 1").count()
    got = sharding.shards_by_bytes(docs, 8)
    cut = got.groupBy("text_crc32").agg(F.count_distinct("shard").alias("k")).where("k > 1").count()
    print("pairs cut at first", at_random, "and at last", cut, "of 1500")
    assert at_random > 1200 and cut < 0.03 * 1500


def test_mixing(spark, odd, empty):
    got = mixing.mix_plan(odd).collect()
    assert len(got) == len(awkward())
    total = sum(r["size"] for r in got)
    own = {(r["source_size"], r["target"]) for r in got}
    assert sum(t for _, t in own) == pytest.approx(total)
    assert all(t <= 3 * s + 1e-6 for s, t in own) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix_plan(empty).count() == 0 and mixing.mixed(empty).count() == 0
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    assert out.count() == sum(r["n_copies"] for r in got)


def test_mixing_targets(spark):
    rows = [(i, " ".join(["w"] * n), "en", s, 0) for i, (s, n) in enumerate([("a", 600), ("b", 10), ("c", 390), (None, 0)])]
    got = {r["source_size"]: r["target"] for r in mixing.mix_plan(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {600: pytest.approx(970 / 4), 10: 30.0, 390: pytest.approx(970 * 3 / 4), 0: 0.0}


# ---- pipeline


def test_pipeline_against_plain_version(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given = {r["doc_id"]: r for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    known = stage["language"](spark, docs, sf)
    told = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, language.fit(docs)).collect()}
    rows = {i: r["text"] for i, r in given.items() if told[i][0] != "und" and told[i][1] >= corpus_pipeline.LEAST_SCORE}
    assert {r["doc_id"]: (r["text"], r["lang"]) for r in known.collect()} == {i: (t, given[i]["lang"] or told[i][0]) for i, t in rows.items()}
    single = stage["near_duplicates"](spark, known, sf)
    groups = brute_groups(list(rows.items()))
    kept = {i for i, (_, c) in groups.items() if c == i}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(kept)
    plan = {r["doc_id"]: r["n_copies"] for r in mixing.mix_plan(single).collect()}
    mixed = stage["mixing"](spark, single, sf)
    assert mixed.columns == docs.columns
    copies = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert copies == collections.Counter({i: n for i, n in plan.items() if n})
    out = corpus_pipeline.run(spark, sf).collect()
    check_packing(out, [(i, rows[i]) for i, n in copies.items() for _ in range(n)])
    for r in out:
        ids = np.frombuffer(r["ids"], "<u2").tolist()
        assert crc(ids) == r["ids_crc32"] and len(ids) == r["length"]


def test_pipeline_takes_the_same_text_of_a_repeated_id(spark, sf):
    import corpus_pipeline

    rows = [(1, words(30, 1), "en", "a", 0), (2, words(40, 5), "en", "b", 0), (2, words(40, 3), "en", "a", 0), (2, words(40, 5), "en", "a", 0), (None, "x y", "en", "a", 0)]
    kept = [sorted(map(str, dict(corpus_pipeline.STAGES)["near_duplicates"](spark, spark.createDataFrame(some, DOC).repartition(n), sf).collect())) for some, n in ((rows, 1), (rows[::-1], 3))]
    assert kept[0] == kept[1] and len(kept[0]) == 3


def test_pipeline_awkward(spark, odd):
    import corpus_pipeline

    df = odd
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF)
        if name != "packing":
            assert df.columns == odd.columns
    assert df.count() > 0


def test_a_worker_keeps_only_what_its_task_needs():
    path = P.path("word_bpe_49k.json")
    table = piece_table(path)
    run = lambda given: iter(given)
    assert list(frugal(run, piece_table)([1])) == [1] and piece_table(path) is table
    assert list(frugal(run)([1, 2])) == [1, 2] and piece_table(path) is not table
    table = piece_table(path)
    assert eased(max, 1, 2) == 2 and piece_table(path) is not table
