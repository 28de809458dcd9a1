"""Behaviour of the operators on small inputs of our own."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from grainmill.functions import lexer, query_text
from grainmill.functions import text as t
from grainmill.operators import audit, cursors, feeds, ingest, parsing, retrieval, state
from grainmill.operators.visibility import array_has, clamp_limit, readable

DAY = dt.datetime(2024, 1, 1)


def heads(spark, n=25, private=(), taken_down=(), gone=()):
    rows = [(i, f"q{i:02d}", f"q{i:02d}-v1", f"Title {i}", "body", "", "sentinel", ["Alpha"], ["where"], ["tag"], "src", i % 3, DAY + dt.timedelta(minutes=i), "private" if i in private else "public", False, 1 if i == 4 else 0) for i in range(n)]
    made = spark.createDataFrame(rows, "doc_id long, query_id string, version_id string, title string, kql string, description string, dialect string, tables array<string>, operators array<string>, tags array<string>, repository string, owner_id long, updated_at timestamp_ntz, visibility string, trusted boolean, star_count long")
    return made.withColumns({"moderation_status": F.when(F.col("doc_id").isin(list(taken_down)), "unpublished").otherwise("visible"), "deleted": F.col("doc_id").isin(list(gone))})


def test_public_feed_pages_are_the_whole_order(spark):
    h = heads(spark)
    first = feeds.public_feed(h).collect()
    assert len(first) == 21 and first[0]["query_id"] == "q04"
    last = first[19]
    second = feeds.public_feed(h, (last["star_count"], last["updated_at"], last["query_id"])).collect()
    ids = [r["query_id"] for r in first[:20]] + [r["query_id"] for r in second]
    assert len(second) == 5 and len(set(ids)) == 25


def test_private_rows_are_their_owners_only(spark):
    h = heads(spark, 6, private=(1,))
    index = retrieval.build_index(retrieval.index_documents(h))
    now = F.lit(DAY).cast("timestamp_ntz")
    for viewer, seen in ((None, False), (2, False), (1, True)):
        assert (h.where(readable(viewer)).where("query_id = 'q01'").count() == 1) is seen
        hits = {r["query_id"] for r in retrieval.lexical(h, h, index, "title", readable(viewer), now).collect()}
        assert ("q01" in hits) is seen
        assert (state.in_given_order(h.where(readable(viewer)), [1, 2]).where("query_id = 'q01'").count() == 1) is seen


def test_deleted_and_moderated_rows(spark):
    h = heads(spark, 8, private=(1,), taken_down=(2, 3), gone=(4, 1))
    seen = lambda viewer: {r["doc_id"] for r in h.where(readable(viewer)).collect()}
    assert seen(None) == {r["doc_id"] for r in h.collect()} - {1, 2, 3, 4}
    assert {d for d in seen(0) if d in (1, 2, 3, 4)} == {3}  # the owner of 3 still sees it, nobody sees what was deleted


def test_search_in_any_script(spark):
    h = heads(spark, 4).withColumn("title", F.element_at(F.array(*map(F.lit, ["Вход пользователя", "漢字 表", "naïve x_y names", "plain"])), (F.col("doc_id") % 4 + 1).cast("int")))
    index = retrieval.build_index(retrieval.index_documents(h))
    now = F.lit(DAY).cast("timestamp_ntz")
    for text, title in (("вход", "Вход пользователя"), ("漢字", "漢字 表"), ("NAÏVE", "naïve x_y names"), ("x_y", "naïve x_y names")):
        assert retrieval.lexical(h, h, index, text, readable(None), now).first()["title"] == title
    assert retrieval.lexical(h, h, index, "?!", readable(None), now).count() == 0


def test_stars_count_once_and_go_with_publicity(spark):
    h = heads(spark, 3, private=(2,))
    stars = spark.createDataFrame([(7, 1), (7, 2)], "user_id long, doc_id long")
    assert [r["doc_id"] for r in state.surviving_stars(stars, h).collect()] == [1]
    assert [r["query_id"] for r in feeds.starred(h, stars, 7).collect()] == ["q01"]


def test_merging_twice_changes_nothing(spark):
    none = spark.createDataFrame([], "query_id string, version_number long, content_hash string")
    batch = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("a", "h1")], "query_id string, content_hash string")
    once = state.merged_versions(none, batch)
    assert once.count() == 2
    assert sorted(state.merged_versions(once, batch).collect()) == sorted(once.collect())
    more = state.merged_versions(once, spark.createDataFrame([("a", "h9")], batch.schema))
    assert more.where("query_id = 'a'").agg(F.max("version_number")).first()[0] == 2


def test_current_version_moves_forward_or_restores(spark):
    versions = spark.createDataFrame([("a", 1, "h1"), ("a", 2, "h2")], "query_id string, version_number long, content_hash string")
    back = spark.createDataFrame([("a", "h1")], "query_id string, content_hash string")
    for deleted, expect in ((False, 2), (True, 1)):
        h = spark.createDataFrame([("a", 2, deleted)], "query_id string, current_number long, deleted boolean")
        row = state.merged_heads(h, versions, back).first()
        assert (row["current_number"], row["deleted"]) == (expect, False)


def test_outbox_of_equal_states_is_empty_and_changes_are_delete_and_upsert(spark):
    cols = "query_id string, version_id string, visibility string, owner_id long, live boolean"
    a = spark.createDataFrame([("a", "v1", "public", 1, True)], cols)
    b = spark.createDataFrame([("a", "v1", "private", 1, True)], cols)
    gone = spark.createDataFrame([("a", "v1", "public", 1, False)], cols)
    assert state.outbox_diff(a, a).count() == 0
    assert [(r["operation"], r["namespace_kind"], r["owner_id"]) for r in state.outbox_diff(a, b).orderBy("operation").collect()] == [("delete", "public", None), ("upsert", "private", 1)]
    assert [r["operation"] for r in state.outbox_diff(a, gone).collect()] == ["delete"]


def test_stream_gives_the_vectors_of_a_rebuild(spark, sf):
    from grainmill.streaming import outbox

    got = outbox.replay(spark, sf)
    assert got.count() > 0
    assert got.where(F.col("version_id").endswith("-v0")).count() == 0
    assert got.select("vector_id").distinct().count() == got.count()


def test_rate_limit_stream(spark, tmp_path):
    from grainmill.streaming import rate_limit

    rows = [(1, DAY + dt.timedelta(seconds=s)) for s in range(12)] + [(2, DAY)] + [(9, DAY + dt.timedelta(hours=1))]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in"))
    q = rate_limit.limited(source).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["requests"], r["refused"]) for r in spark.sql("select * from limited").collect()) == [(1, 0), (12, 2)]


def test_adequacy_order(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "place int, title string, tables array<string>, score double")
    told = lambda df, q: tuple(retrieval.adequacy(df, q).first())
    assert told(rows((1, "x", [], 0.1)).limit(0), "q") == (False, 0.0, "no-results")
    assert told(rows((1, "x", ["T"], 0.99), (2, "My  Title!", [], 0.2)), "my title") == (True, 0.96, "exact-title")
    assert told(rows((1, "x", ["SignIn"], 0.5)), "signin") == (True, 0.9, "exact-table")
    assert told(rows((1, "x", [], 0.8)), "q") == (True, 0.8, "strong-score")
    assert told(rows((1, "x", [], 0.65), (2, "y", [], 0.5)), "q") == (True, 0.65, "clear-leading-result")
    assert told(rows((1, "x", [], 0.65), (2, "y", [], 0.6)), "q") == (False, 0.65, "weak-score")


def test_hybrid_needs_the_current_version(spark):
    lex = spark.createDataFrame([("a", "a1", 0.5, 0)], "query_id string, version_id string, score double, star_count long")
    auth = spark.createDataFrame([("a", "a1", 0), ("b", "b2", 3)], "query_id string, version_id string, star_count long")
    cand = spark.createDataFrame([("a", "a1", 0.9, 1), ("b", "b1", 0.99, 2)], "query_id string, version_id string, score double, place int")
    got = retrieval.hybrid(lex, auth, cand).collect()
    assert [(r["query_id"], r["match_type"]) for r in got] == [("a", "hybrid")]
    assert got[0]["score"] == pytest.approx(0.5 * 0.62 + 0.9 * 0.38 + 0.06)


def test_search_stops_when_adequate_and_merges_otherwise(spark):
    h = heads(spark, 12, private=(3,))
    v = h.select(F.col("doc_id").alias("vec_id"), "query_id", "version_id", F.array(F.lit(1.0), F.col("doc_id").cast("double")).alias("embedding"))
    now = F.lit(DAY).cast("timestamp_ntz")
    found, told = retrieval.search(h, h, retrieval.build_index(retrieval.index_documents(h)), v, "title 4", readable(None), now, [1.0, 3.0])
    assert told["reason"] == "exact-title" and {r["match_type"] for r in found.collect()} == {"lexical"}
    found, told = retrieval.search(h, h, retrieval.build_index(retrieval.index_documents(h)), v, "zzz", readable(None), now, [1.0, 3.0])
    rows = found.collect()
    assert told["reason"] == "no-results" and rows and {r["match_type"] for r in rows} == {"semantic"}
    assert "q03" not in {r["query_id"] for r in rows}


def test_match_terms():
    assert retrieval.match_terms("A SignIn signin x_y  é1") == ["signin", "x", "y", "e1"]
    assert len(retrieval.match_terms(" ".join(f"w{i}" for i in range(30)))) == 16
    assert retrieval.match_terms("! ?") == []


def test_cursors():
    assert cursors.decode_list("2024%7C1") == ("2024", "1")
    assert cursors.decode_ranked("3%7Ct%7Cid") == (3, "t", "id")
    for bad in ("x", "%7Ca", "a%7C"):
        with pytest.raises(ValueError):
            cursors.decode_list(bad)
    with pytest.raises(ValueError):
        clamp_limit(0)
    assert clamp_limit(None) == 25


def test_text_rules(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(t.normalize_body(F.lit("﻿\r\n\r\na  \r\n\n\n\n  b\t\n\n"))) == "a\n\n  b"
    assert one(t.first_spelling(F.array(*map(F.lit, ["A", "b", "a", "B"])))) == ["A", "b"]
    assert one(t.last_spelling(F.array(*map(F.lit, ["A", "b", "a", "B"])))) == ["a", "B"]
    assert one(t.strip_strings(F.lit('[1, "a", null, "b"]'))) == ["a", "b"]
    assert one(t.strip_strings(F.lit("nope"))) == []
    assert one(t.is_generic_title(F.lit("Microsoft Sentinel & Defender XDR 5"))) is True
    assert one(t.is_generic_title(F.lit("Failed logons"))) is False
    assert one(t.title_from_path(F.lit("a/b/failedSignIns_byUser.kql"))) == "failed Sign Ins by User"
    assert one(t.matched_rules(F.lit("password = 'abcdefgh1'"), t.SECRET_RULES)) == ["assigned-secret"]


def test_file_gate(spark):
    rows = [("MIT", "a/b.kql", "T"), ("GPL-3.0", "a.kql", "T"), (None, "a.kql", "T"), ("MIT", "../a.kql", "T"), ("MIT", "a.txt", "T"), ("MIT", "a.md", "  "), ("MIT", "a.kql", "// SPDX-License-Identifier: ISC\nT"), ("MIT", "a.kql", "x" * 1_000_001)]
    got = ingest.gated_files(spark.createDataFrame(rows, "spdx string, path string, content string")).collect()
    assert [r["skip_reason"] for r in got] == [None, "LICENSE_NOT_ALLOWED", "LICENSE_MISSING", "UNSAFE_PATH", "UNSUPPORTED_FILE", "EMPTY_FILE", "LICENSE_METADATA_MISMATCH", "FILE_TOO_LARGE"]


def test_markdown_fences(spark):
    text = "# One\n```kql\nT | take 1\n```\n```sql\nselect\n```\n```Kusto\nT | take 2"
    got = parsing.markdown_blocks(spark.createDataFrame([("a.md", text)], "path string, content string"), ["path"]).orderBy("block").collect()
    assert [(r["block"], r["title"], r["body"]) for r in got] == [(0, "One", "T | take 1"), (2, "One 2", "T | take 2")]


def test_query_text(spark):
    body = "let a = SignIn;\n// T | where x\na | where y == \"b|c\" | join kind=inner (Audit) on z | order   by t"
    row = spark.createDataFrame([(1, body)], "k int, body string")
    got = row.select(query_text.source_tables(F.col("body")), query_text.pipe_operators(F.col("body")), query_text.structural_problem(F.col("body"))).first()
    assert (sorted(got[0]), got[1], got[2]) == (["Audit", "SignIn"], ["where", "join", "order by"], None)
    toks = lexer.lexemes(row, "k", "body").orderBy("start").collect()
    assert all(body[r["start"] : r["stop"]] == r["token"] for r in toks)
    assert all(a["stop"] <= b["start"] for a, b in zip(toks, toks[1:]))


def test_manifest_and_tree(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('repository,path,branch\nA/b,"x, ""y""\nz",main\na/B,p,main\n')
    rows = ingest.read_manifest(spark, str(path), ("repository", "path"))
    assert rows.count() == 2
    group = ingest.manifest_groups(rows).collect()
    assert len(group) == 1 and group[0]["paths"] == 2 and group[0]["consistent"]
    with pytest.raises(ValueError):
        ingest.read_manifest(spark, str(path), ("license",))
    (tmp_path / "t" / "d").mkdir(parents=True)
    (tmp_path / "t" / "d" / "a.kql").write_text("T")
    (tmp_path / "t" / "b.bin").write_bytes(b"\xff\xfe")
    got = {r["path"].rsplit("/", 1)[1]: r["content"] for r in ingest.read_tree(spark, str(tmp_path / "t")).collect()}
    assert got == {"a.kql": "T", "b.bin": None}


def test_audit(spark):
    rows = spark.createDataFrame([("a", "KQL", "", ["where"], [], "# Heading\nT", "s", False), ("b", "Fine title", "d", ["T"], ["x"], "T | datatable(Description:string)", "s", True)], "query_id string, title string, description string, tables array<string>, tags array<string>, kql string, repository string, version_known boolean")
    got = {(r["query_id"], r["code"]) for r in audit.findings(rows).collect()}
    assert {c for q, c in got if q == "a"} == {"dangling-version", "empty-description", "empty-tags", "generic-title", "prose-wrapper", "suspicious-table"}
    assert not {c for q, c in got if q == "b"}


def test_array_filter_ignores_case(spark):
    h = heads(spark, 2)
    assert h.where(array_has("tables", ["ALPHA"])).count() == 2
    assert h.where(array_has("tables", [])).count() == 2
    assert h.where(array_has("tables", ["beta"])).count() == 0


def test_deep_brackets_pair(spark):
    deep = "([{" * 40 + "}])" * 40
    rows = [(f"T | where {deep}",), (f"T | where {deep[:-1]}",), ("T | where ([)]",), ("T | where )(",), ("T",)]
    got = spark.createDataFrame(rows, "body string").select(query_text.structural_problem(F.col("body"))).collect()
    assert [r[0] for r in got] == [None, *["unbalanced-delimiter"] * 3, None]
