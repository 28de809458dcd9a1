"""Search requests, id resolution and authored queries."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from grainmill.operators import ingest, lifecycle, request, resolve, retrieval, state


def test_params():
    r = request.from_params({"q": ["  a  b "], "dialect": ["Sentinel,adx"], "dialects": ["kusto"], "table": ["A,a", "B"], "limit": ["50"]})
    assert (r.q, r.filters["dialects"], r.filters["tables"], r.limit) == ("a b", ["sentinel", "azure-data-explorer"], ["A", "B"], 50)
    assert request.from_body({"q": "x", "tags": ["t"]}).limit == 20


@pytest.mark.parametrize("params,code", [
    ({}, "query_required"), ({"q": ["x" * 2001]}, "query_too_long"), ({"q": ["x"], "limit": ["0"]}, "invalid_limit"), ({"q": ["x"], "limit": ["1.5"]}, "invalid_limit"),
    ({"q": ["x"], "dialect": ["sql"]}, "invalid_dialect"), ({"q": ["x"], "tag": ["y" * 121]}, "filter_too_long"), ({"q": ["x"], "tags": [",".join(map(str, range(21)))]}, "too_many_filters"), ({"q": ["x"], "cursor": ["\x01"]}, "invalid_cursor"),
])
def test_bad_params(params, code):
    with pytest.raises(request.RequestError) as e:
        request.from_params(params)
    assert e.value.code == code


def test_bad_bodies():
    for body, code in (([], "invalid_body"), ({"q": "x", "tags": "t"}, "invalid_filter"), ({"q": "x", "limit": "5"}, "invalid_limit"), ({"q": 5}, "query_required")):
        with pytest.raises(request.RequestError) as e:
            request.from_body(body)
        assert e.value.code == code


def test_intents():
    r = request.from_body({"q": "x"})
    assert request.dialect_required(r, "sentinel", 0.7) and not request.dialect_required(r, "sentinel", 0.75)
    assert request.intent_text(r, {"query": "", "concepts": ["c"], "tags": ["t"]}) == "x c t"


def test_ids_follow_the_text_when_blocks_shift(spark):
    new = spark.createDataFrame([("f", 0, "n0", "A"), ("f", 1, "n1", "B"), ("f", 2, "n2", "A"), ("g", 0, "n3", "A")], "path string, block long, new_id string, body string")
    old = spark.createDataFrame([("f", 0, "o0", "B ", None, False), ("f", 5, "o5", "A", None, True), ("f", 4, "o4", "A", None, False), ("f", 2, "o2", "Z", None, False), ("f", 1, "ox", "A", 9, False)], "path string, block long, query_id string, body string, owner_id long, deleted boolean")
    got = {(r["path"], r["block"]): (r["query_id"], r["how"]) for r in resolve.resolved_ids(new, old).collect()}
    assert got == {("f", 0): ("o4", "text"), ("f", 1): ("o0", "text"), ("f", 2): ("o5", "text"), ("g", 0): ("n3", "new")}


def test_blocks_take_the_best_query_that_is_left(spark):
    import random

    r = random.Random(1)
    new = [(f"f{k % 3}", k // 3, f"n{k}", r.choice("AB")) for k in range(60)]
    old = [(f"f{k % 3}", r.randrange(40), f"o{k:02d}", r.choice("ABC"), None, r.random() < 0.3) for k in range(50)]
    used, want = set(), {}
    for how, fits in (("text", lambda n, o: n[3] == o[3]), ("place", lambda n, o: n[1] == o[1])):
        for n in sorted(new, key=lambda n: n[1]):
            free = [o for o in old if o[0] == n[0] and o[2] not in used and fits(n, o)]
            if n[:2] not in want and free:
                o = min(free, key=lambda o: (o[1] != n[1], o[5], abs(o[1] - n[1]), o[1], o[2]))
                want[n[:2]] = (o[2], how)
                used.add(o[2])
    want |= {n[:2]: (n[2], "new") for n in new if n[:2] not in want}
    got = resolve.resolved_ids(spark.createDataFrame(new, "path string, block long, new_id string, body string"), spark.createDataFrame(old, "path string, block long, query_id string, body string, owner_id long, deleted boolean"))
    assert {(x["path"], x["block"]): (x["query_id"], x["how"]) for x in got.collect()} == want


def test_several_edits_of_a_query_are_numbered(spark):
    empty = {c: F.array().cast("array<string>") for c in ("tables", "operators", "tags")}
    edits = spark.createDataFrame([("q", 1, k, f"T{b}") for k, b in ((1, 1), (2, 1), (3, 2), (4, 1))] + [("q", 2, 5, "X"), ("p", 1, 1, "T0")], "query_id string, editor long, at long, kql string")
    edits = edits.withColumns({"title": F.lit("t"), "description": F.lit("d"), "dialect": F.lit("s"), **empty})
    current = edits.limit(0).select("query_id").union(spark.createDataFrame([("q",), ("p",)], "query_id string"))
    first = edits.where("kql = 'T0'").select(lifecycle.content_hash().alias("h")).first()["h"]
    current = current.withColumns({"owner_id": F.lit(1).cast("long"), "version_number": F.lit(4).cast("long"), "content_hash": F.lit(first)})
    got = [tuple(r) for r in lifecycle.updated(current, edits, at="at").orderBy("query_id", "version_number").select("query_id", "version_number", "kql").collect()]
    assert got == [("q", 5, "T1"), ("q", 6, "T2"), ("q", 7, "T1")]


def test_repeated_keys_do_not_multiply_rows(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z")], "k int, v string")
    assert sorted(map(tuple, state.upserted(old, new, "k").collect())) == [(1, "y"), (2, "b"), (3, "z")]
    reports = spark.createDataFrame([(7,), (8,)], "doc_id long")
    assert state.unpublish(reports, spark.createDataFrame([(7,), (7,)], "doc_id long")).count() == 2


def test_a_stored_index_follows_the_files_and_versions(spark, tmp_path):
    from grainmill.plans import search_queries

    spark.range(3).write.parquet(str(tmp_path / "documents.parquet"))
    files = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path / "documents.parquet")).agg(F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
    before = files()
    assert before == files()
    spark.range(4).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert before != files() and isinstance(search_queries._INDEXES, dict)
    rows = [(1, "1", "1-v1", "alpha word", "public"), (2, "2", "2-v1", "alpha other", "public")]
    docs = spark.createDataFrame(rows, "doc_id long, query_id string, version_id string, title string, visibility string").withColumns({c: F.lit("x") for c in ("tables", "description", "kql", "operators", "tags", "author", "repository")})
    index = retrieval.build_index(docs)
    heads = docs.withColumns({"tables": F.array(F.lit("x")), "star_count": F.lit(0).cast("long"), "trusted": F.lit(False), "updated_at": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), "version_id": F.when(F.col("doc_id") == 2, "2-v2").otherwise(F.col("version_id"))})
    now = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    assert [r["doc_id"] for r in retrieval.lexical(heads, docs, index, "alpha", F.lit(True), now).collect()] == [1]


def test_publishing_needs_a_sound_body_and_its_owner(spark):
    rows = [("a", "T | take 1", 1), ("b", "T | where (x", 1), ("c", "T", 2)]
    heads = spark.createDataFrame(rows, "query_id string, kql string, owner_id long").withColumns({"visibility": F.lit("private"), "published_at": F.lit(None).cast("timestamp_ntz")})
    wishes = spark.createDataFrame([(q, "public", 1) for q in "abc"], "query_id string, visibility string, owner_id long")
    now = F.lit(dt.datetime(2024, 5, 1)).cast("timestamp_ntz")
    got = {r["query_id"]: (r["visibility"], r["published_at"] is not None) for r in lifecycle.with_visibility(heads, wishes, now).collect()}
    assert got == {"a": ("public", True), "b": ("private", False), "c": ("private", False)}


def test_tree_limits(spark, monkeypatch):
    tree = spark.createDataFrame([("r", f"{i}.kql", 1) for i in range(5)], "repository string, path string, size long")
    assert ingest.checked_tree(tree).count() == 5
    with pytest.raises(ValueError):
        ingest.checked_tree(tree, truncated=True)
    monkeypatch.setattr(ingest, "MAX_CANDIDATES", 4)
    with pytest.raises(ValueError):
        ingest.checked_tree(tree)
