"""Taking queries down, audits of versions, and what queries read, on small inputs."""

from __future__ import annotations

import collections

from pyspark.sql import functions as F

from grainmill.functions.query_text import scope_summary
from grainmill.operators import audit, moderation


def test_take_down(spark):
    heads = spark.createDataFrame(
        [(1, "public", "visible", False, 0), (2, "private", "visible", False, 0), (3, "public", "unpublished", False, 0), (4, "public", "visible", True, 0), (5, "public", "visible", False, 0)],
        "doc_id long, visibility string, moderation_status string, deleted boolean, updated_at long",
    )
    users = spark.createDataFrame([(7, "admin"), (7, "admin"), (8, "admin"), (9, "user"), (None, "admin")], "user_id long, role string")
    reports = spark.createDataFrame([(1, 1, "open"), (2, 1, "dismissed"), (3, 2, "open"), (4, 5, "open"), (5, None, "open")], "report_id long, doc_id long, status string")
    asked = [(10, 1, 9, "x", 1), (11, 1, 8, "  late ", 5), (12, 1, 7, "y" * 3000, 2), (13, 2, 7, None, 1), (14, 3, 7, None, 1), (15, 4, 7, None, 1), (16, 99, 7, None, 1), (17, None, 7, None, 1), (18, 5, None, None, 1)]
    requests = spark.createDataFrame(asked, "request_id long, doc_id long, admin_id long, reason string, at long")
    got = moderation.take_down(requests, users, heads, reports)
    outcomes = {r["request_id"]: r["outcome"] for r in got.outcomes.collect()}
    assert outcomes == {10: "ADMIN_REQUIRED", 12: "unpublished", 18: "ADMIN_REQUIRED"} | dict.fromkeys([11, 13, 14, 15, 16, 17], "PUBLIC_QUERY_NOT_FOUND")
    (entry,) = got.log.collect()
    assert (entry["doc_id"], entry["admin_id"], entry["action"], len(entry["reason"]), entry["previous_visibility"]) == (1, 7, "unpublish", 2000, "public")
    assert {(r["doc_id"], r["moderation_status"], r["updated_at"]) for r in got.heads.collect()} == {(1, "unpublished", 2), (2, "visible", 0), (3, "unpublished", 0), (4, "visible", 0), (5, "visible", 0)}
    closed = {r["report_id"]: (r["status"], r["reviewed_by"], r["reviewed_at"]) for r in got.reports.collect()}
    assert closed == {1: ("actioned", 7, 2), 2: ("dismissed", None, None), 3: ("open", None, None), 4: ("open", None, None), 5: ("open", None, None)}
    none = moderation.take_down(requests.limit(0), users, heads, reports)
    assert none.outcomes.count() == 0 and none.heads.count() == 5 and none.log.count() == 0


def test_audit(spark):
    heads = spark.createDataFrame(
        [("a", "a1", False), ("b", None, False), ("c", "", False), ("d", "zz", False), ("e", "a1", False), ("f", None, True), ("g", "g1", False), ("h", "h1", False), ("i", "i1", False)],
        "query_id string, current_version_id string, deleted boolean",
    )
    fine = ("Sign-ins by country", "SigninLogs | take 5", "It counts.", "It does.", ["SigninLogs"], ["tag"])
    versions = [("a1", "a", *fine), ("g1", "g", " sign-INS by country ", *fine[1:]), ("h1", "h", fine[0], *fine[1:]), ("i1", "i", "Query", "// note\nT | where (x", "", None, ["As"], [])]
    versions = spark.createDataFrame(versions, "version_id string, query_id string, title string, kql string, description string, explanation string, tables array<string>, tags array<string>")
    provenance = spark.createDataFrame([("a", "s1", "p"), ("g", "s2", "p"), ("g", "s2", "q"), ("h", "s1", ""), ("i", "s1", "p")], "query_id string, source_repository_id string, source_path string")
    repositories = spark.createDataFrame([("s1", "O/R"), ("s2", "o/r")], "source_repository_id string, repository string")
    got = collections.defaultdict(set)
    rows = audit.audited(heads, versions, provenance, repositories).collect()
    for r in rows:
        got[r["query_id"]].add((r["code"], r["detail"]))
    assert len(rows) == sum(map(len, got.values()))
    # g has the title of a in the same source, whatever the case; h has no path
    assert {k: v for k, v in got.items() if k != "i"} == {
        "b": {("current-version", "missing")}, "c": {("current-version", "missing")}, "d": {("current-version", "dangling")}, "e": {("current-version", "foreign")}, "g": {("duplicate-source-title", "a")},
    }
    assert {c for c, _ in got["i"]} == {"empty-description", "empty-explanation", "empty-tags", "generic-title", "invalid-structure", "suspicious-table"}


def test_scopes(spark):
    every, chosen, none = "All tables in the current scope", "Table name selected at runtime", "No physical table referenced"
    cases = [
        ("T | take 1", ["T", "U"], [], "T, U"), ("search 'x'", [], [], every), ("search in (T) 'x'", [], [], none), ("find kind=a withsource=b in (T) where x", [], ["FIND"], none), ("T\n|  search 'x'", [], [], every),
        ("let a = find where x; a", [], [], every), ("// search 'x'\nprint 1", [], [], none), ("print '; search'", [], [], none), ("print 1", [], [" Search "], every), ("union *", [], [], every),
        ("union kind=outer isfuzzy=true *", [], [], every), ("union T, U", [], [], none), ("table(name) | take 1", [], [], chosen), ("table('T')", [], [], none), ("print research(1)", [], [], none), (None, [], [], none), ("", [], [], none),
        ("search in (T) 'x'; search 'y'", [], [], every), ("print 1 // " + "search x " * 20_000, [], [], none),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, body string, tables array<string>, operators array<string>")
    got = df.select("i", scope_summary(F.col("body"), F.col("tables"), F.col("operators")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == [c[3] for c in cases]


def test_content_hash_has_ten_keys(spark):
    import hashlib
    import json

    from grainmill.operators import lifecycle

    row = (" Title ", "T\r\n| take 1\r\n", "d ", "\ne", "sentinel", ["T"], ["take"], [], ["it holds"], None)
    names = "title string, kql string, description string, explanation string, dialect string, tables array<string>, operators array<string>, tags array<string>, assumptions array<string>, validation_warnings array<string>"
    df = spark.createDataFrame([row], names)
    want = {"title": "Title", "kql": "T\n| take 1", "description": "d", "explanation": "e", "dialect": "sentinel", "tables": ["T"], "operators": ["take"], "tags": [], "assumptions": ["it holds"], "validationWarnings": []}
    digest = lambda x: hashlib.sha256(json.dumps(x, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert df.select(lifecycle.content_hash(df)).first()[0] == digest(want)
    bare = df.drop("explanation", "assumptions", "validation_warnings")
    assert bare.select(lifecycle.content_hash(bare)).first()[0] == bare.select(lifecycle.content_hash()).first()[0] == digest(want | {"explanation": "", "assumptions": []})
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    first = lifecycle.created(df.withColumn("query_id", F.lit("q")), now).first()
    assert first["content_hash"] == digest(want) and first["version_number"] == 1
    current = spark.createDataFrame([("q", 1, 1, digest(want))], "query_id string, owner_id long, version_number long, content_hash string")
    edits = df.withColumns({"query_id": F.lit("q"), "editor": F.lit(1)})
    assert lifecycle.updated(current, edits).count() == 0
    assert lifecycle.updated(current, edits.withColumn("validation_warnings", F.array(F.lit("w")))).select("version_number").first()[0] == 2
