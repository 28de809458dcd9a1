"""Shared lines, conversation tries and importance resampling: awkward tables, brute force, hot keys."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grainmill.llm import importance, line_dedup, prefix_trie, radix
from tests.llm.test_operators import CLASH, DOC, awkward, words

WS = " \t\n\x0b\x0c\r"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# ---- 11

LINE = "A line that is quite long enough to be counted, at 40 code points"


def line_rows():
    shared = "\n".join([LINE, "short", f"\t {LINE.upper()} \r", "été " * 10, "own words here " + "x" * 40])
    rows = [(i, f"{shared}\nnumber {i}\n", "en", "a") for i in range(1, 7)]
    rows += [(2, f"{shared}\nnumber 2\n", "en", "a"), (3, LINE, None, None), (None, LINE, None, None), (None, None, None, None), (9, "", "en", "b"), (10, "\n\n", "en", "b")]
    rows += [(11, "\n".join(["z" * 40] * 3), "en", "b"), (12, "z" * 40, "en", "b"), (13, "y" * 39 + " ", "en", "b"), (14, "\n".join(f"{'w' * 50}{k}" for k in range(5000)), "en", "b")]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


def brute_lines(rows, least_chars=40, least_docs=5):
    key = lambda line: lowered(line.strip(WS))
    held = collections.defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                held[key(line)].add(i)
    count = lambda ids: len(ids - {None}) + (None in ids)
    last = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if count(ids) >= least_docs}
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) in last and last[key(x)] != i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def same(df, rows):
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, rows))


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_lines_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", broadcast)
    rows = line_rows()
    df = spark.createDataFrame(rows, DOC).repartition(3).withColumns({c: F.lit("x") for c in [*CLASH, "at", "pos", "key", "h", "id", "whole"]})
    same(line_dedup.line_digests(df), brute_lines(rows))
    out = line_dedup.without_shared_lines(df).where("doc_id = 10 or doc_id = 1").orderBy("doc_id").collect()
    assert [r["text"] for r in out] == ["short\n" + "été " * 10 + "\nnumber 1\n", "\n\n"]  # 39 code points without the blank at the end
    assert out[0]["row"]["text"] == rows[0][1] and out[0]["row"]["size"] == "x"


def test_lines_of_awkward_and_empty_tables(spark):
    rows = awkward()
    same(line_dedup.line_digests(spark.createDataFrame(rows, DOC)), brute_lines(rows))
    assert line_dedup.line_digests(spark.createDataFrame([], DOC)).count() == 0


def test_a_line_of_all_documents(spark):
    rows = [(i, f"{LINE}\n{words(8, i)}\n{LINE}", "en", "a", 0) for i in range(2000)]
    same(line_dedup.line_digests(spark.createDataFrame(rows, DOC).repartition(8)), brute_lines(rows))


# ---- 12

TURN = "conv_id long, turn int, role string, text string"


def brute_trie(rows):
    digest = lambda role, text: hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[2] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    seqs = {}
    for c in own:
        h, family = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c > 0 else -1)
        seqs[c] = tuple(own.get(family, [])[:h] + own[c][h:])
    members = collections.defaultdict(list)
    for c, s in sorted(seqs.items()):
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    out = []
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        leaves = sum(all(len(seqs[c]) == len(x) for c in members[x]) for x in below)
        ends = ",".join(str(c) for c in m if len(seqs[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out.append((m[0], len(node), parent, len(m), sum(len(x) == len(node) + 1 for x in below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def random_conversations(seed, n, far=False):
    r, rows = random.Random(seed), []
    for k in range(n):
        c = r.randrange(-(1 << 62), 1 << 62) if far and k % 3 == 0 else k - 30
        for t in range(r.choice([1, 1, 2, 3, 5])):
            rows.append((c, r.choice([t, t, None, 0]), r.choice(["user", None, "assistant"]), r.choice(["a b", "a b", "c", "", None, f"x{k}"])))
    return rows


@pytest.mark.parametrize("most", [1, 7, 4096])
def test_trie_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(prefix_trie, "SHARD_CONVERSATIONS", most)
    rows = random_conversations(most, 150, far=most == 7)
    rows += rows[:5] + [(None, 0, "user", "lost"), (5000, 2, "user", "x " * 50_000), (5000, 2, "user", "x " * 50_000), (4000, 1, "us", "er"), (4001, 1, "user", "")]
    df = spark.createDataFrame(rows, TURN).repartition(4).withColumns({c: F.lit("x") for c in ["node", "shard", "first", "n", "depth", "family", "digest", "words", "ends"]})
    same(prefix_trie.prefix_trie(df), brute_trie(rows))


def test_trie_of_equal_conversations_and_of_nothing(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(400) for t in range(3)]
    same(prefix_trie.prefix_trie(spark.createDataFrame(rows, TURN).repartition(6)), brute_trie(rows))
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURN)).count() == 0


def test_turnless_conversations_end_at_the_root(spark):
    # 1 takes up to three turns from conversation 0, which is absent, and has one turn itself
    rows = [(c, 0, "user", "hello there") for c in range(1, 20)]
    out = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURN))
    same(out, brute_trie(rows))
    root = out.where("depth = 0").first()
    gone = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4]
    assert gone and root["ends_sha256"] == hashlib.sha256(",".join(map(str, gone)).encode()).hexdigest()


def test_a_conversation_may_be_long(spark):
    rows = [(c, t, "user", f"turn {t}") for c in (0, 20) for t in range(1500 + c)]
    out = {(r["depth"]): r for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, TURN)).collect()}
    assert len(out) == 1521 and out[0]["n_leaves"] == 1 and out[0]["saved_tokens"] == 3000 and out[1500]["saved_tokens"] == 2


# ---- 13


def test_crc32_of_stretches():
    r = np.random.default_rng(1)
    data = r.integers(0, 256, 5000).astype(np.uint8)
    starts = r.integers(0, 4000, 300)
    lengths = r.choice([0, 1, 2, 5, 63, 64, 65, 500], 300)
    assert importance.crc32_of(data, starts, lengths).tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts, lengths, strict=True)]


def brute_features(text, most, buckets):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text or ""))
    runs = [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]
    return [zlib.crc32(x.encode()) % buckets for x in runs], len(w)


TEXTS = [None, "", "a", "A-b  C", "é1 漢字x", "x" * 300, "one two", "Zz", "..", "tail", "don't\x00stop\x7fnow é", words(300, 1), "q" * 63 + " " + "r" * 64 + " " + "s" * 65]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_features(monkeypatch, most):
    monkeypatch.setattr(importance, "STRETCH", 50)
    for texts in (TEXTS, TEXTS[::-1], TEXTS[3:5]):
        for column in (pa.array(texts), pa.array(["cut", *texts, "off"]).slice(1, len(texts)), pa.array(texts, pa.large_string())):
            got, n_words = collections.defaultdict(list), []
            for at, part in importance._parts(importance._binary(column)):
                bucket, owner, n = importance.features(part, most, 997)
                n_words += n.tolist()
                for b, o in zip(bucket.tolist(), owner.tolist(), strict=True):
                    got[at + o].append(b)
            want = [brute_features(t, most, 997) for t in texts]
            assert [sorted(got[i]) for i in range(len(texts))] == [sorted(f) for f, _ in want]
            assert n_words == [n for _, n in want]


def brute_resampled(rows, target, percent, least_words, most, buckets, seed):
    docs = [(r[0], *brute_features(r[1], most, buckets)) for r in rows]
    s = collections.Counter(b for _, f, _ in docs for b in f)
    t = collections.Counter(b for x in target for b in brute_features(x, most, buckets)[0])
    whole, aim = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * whole / ((s[b] + 1.0) * aim))) for b in range(buckets)]
    out = []
    for i, f, n in docs:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("most", [1, 2])
def test_resampling_against_brute_force(spark, most):
    rows = awkward() + [(100 + k, words(15 + k % 9, k), "en", "a", 0) for k in range(300)] + [(-5, words(40, 3), "en", "a", 0)]
    target = [words(50, k) for k in range(20)] + [None, "", "beta5 " * 40]
    df = spark.createDataFrame(rows, DOC).repartition(5).withColumns({c: F.lit("x") for c in [*CLASH, "n_features", "rank", "weight", "place", "block", "digit"]})
    goal = spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string")
    got = importance.resampled(df, goal, percent=30, least_words=20, most=most, buckets=500, seed="7")
    same(got, brute_resampled(rows, target, 30, 20, most, 500, "7"))


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], DOC)
    assert importance.resampled(none, none).count() == 0
    rows = [(k, words(30, k), "en", "a", 0) for k in range(20)]
    same(importance.resampled(spark.createDataFrame(rows, DOC), none), brute_resampled(rows, [], 10, 20, 1, 10_000, "2024"))


@pytest.mark.parametrize("seed", range(3))
def test_radix_ranks(spark, seed):
    r = random.Random(seed)
    values = [None, 0, -1, 1, 5, 1 << 40, -(1 << 63), (1 << 63) - 1]
    rows = [(r.choice(values) if r.random() < 0.6 else 7, k if seed else r.randrange(-50, 50)) for k in range(3000)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(5)
    got = radix.ranked(df, [radix.Key("a", descending=True), radix.Key("b")], block_rows=100).orderBy("rank").collect()
    want = sorted(rows, key=lambda x: (x[0] is not None, -(x[0] or 0), x[1]))
    assert [(x["a"], x["b"]) for x in got] == want and [x["rank"] for x in got] == list(range(1, len(rows) + 1))


def test_radix_ranks_rows_that_are_all_equal(spark):
    df = spark.range(1000, numPartitions=7).select(F.lit(3).cast("long").alias("a"))
    assert sorted(x["rank"] for x in radix.ranked(df, [radix.Key("a")], block_rows=64).collect()) == list(range(1, 1001))
