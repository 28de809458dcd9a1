"""Masks, tokens, structure, tables and diagnostics on known cases and against walks over single characters."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from grainmill.functions import lexer, query_text
from grainmill.functions import text as t
from grainmill.operators import diagnostics


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, b string").repartition(2)
    return [r["x"] for r in df.select("i", expression(F.col("b")).alias("x")).orderBy("i").collect()]


def walk(text):
    """(mask, closed) of a text, character by character."""
    out, i, closed = list(text), 0, True

    def blank(a, z):
        for k in range(a, min(z, len(text))):
            if out[k] not in "\r\n":
                out[k] = " "

    while i < len(text):
        start = i
        if text.startswith("//", i):
            i = text.find("\n", i) if "\n" in text[i:] else len(text)
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            closed, i = (closed and end >= 0), (end + 2 if end >= 0 else len(text))
        elif text[i : i + 3] in ("```", "~~~"):
            end = text.find(text[i : i + 3], i + 3)
            closed, i = (closed and end >= 0), (end + 3 if end >= 0 else len(text))
        elif text[i] in "\"'" or (text[i] == "@" and text[i + 1 : i + 2] in ("'", '"')):
            verbatim = text[i] == "@"
            i += verbatim
            sign, i, done = text[i], i + 1, False
            while i < len(text) and not done:
                if text[i] == "\\" and not verbatim:
                    i += 2
                elif text[i : i + 2] == sign * 2:
                    i += 2
                else:
                    done, i = text[i] == sign, i + 1
            closed = closed and done
        else:
            i += 1
            continue
        blank(start, i)
    return "".join(out), closed


CASES = ['T // c " x\n| y', "T | where a == \"b // c\" // d", "@\"C:\\\" x \"y\"", "a'b''c'd", "h@'x\\' y", "/* ' */ x", "```\n' //\n``` x", "~~~a~~~b", "'a\\'b' c", "'a\nb'", "\"", "/*", "```", "", "x/y @z ~ `", "'\\"]


def test_masks_against_a_walk(spark):
    r = random.Random(5)
    texts = CASES + ["".join(r.choice(["'", '"', "\\", "/", "/", "*", "@", "`", "```", "\n", "a", " ", "~~~", "(", "é"]) for _ in range(r.randrange(1, 40))) for _ in range(1500)]
    masks, closed = column(spark, texts, lexer.masked), column(spark, texts, lexer.all_closed)
    for text, m, c in zip(texts, masks, closed, strict=True):
        assert (m, c) == walk(text), text


def test_spans_known():
    code = "let n = 8; // where inside\nS\n| where R != 0 and T > ago(1h)\n| summarize F = count() by U, $left.x, ['where'], h@\"tok\"\n| where item in~ (\"x\") and x !in (1.5e3d, 0xFFL)\n| mv-expand a\nprint ```\nwhere 42\n```\n| project-awayx"
    spans = lexer.spans(code)
    of = lambda kind: [code[a:z] for a, z, k in spans if k == kind]
    assert of("keyword") == ["let", "where", "summarize", "by", "where", "mv-expand", "print", "project"] and of("function") == ["ago", "count"]
    assert of("comment") == ["// where inside"] and of("variable") == ["$left"] and of("property") == ["['where']"] and of("string") == ['h@"tok"', '"x"', "```", "where 42", "```"]
    assert of("number") == ["8", "0", "1h", "1.5e3d", "0xFFL"] and "in~" in of("operator") and "!in" in of("operator")
    assert all(a < z and "\n" not in code[a:z] for a, z, _ in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_lexemes_have_places(spark):
    texts = ["T\n| where x == 'a'\n\n  // end", None, "", "é 漢 | take 1"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, b string")
    for names in (False, True):
        for r in lexer.lexemes(rows, "k", "b", names=names).collect():
            text = texts[r["k"]]
            assert text[r["start"] : r["stop"]] == r["token"]
            assert (r["line"], r["col"]) == (text.count("\n", 0, r["start"]) + 1, r["start"] - (text.rfind("\n", 0, r["start"]) + 1) + 1)
    assert {r["k"] for r in lexer.lexemes(rows, "k", "b").collect()} == {0, 3}


STRUCTURE = {
    "T | where x == (1": "unbalanced-delimiter", "T | where x == 'it": "unbalanced-quote", "| where a": "leading-pipe", "let x = 3;": "ends-with-declaration", "let x = ;": "empty-let", "let x = 1;\n| where y": "leading-pipe",
    "T;\n...": "placeholder", "// let Function = () {\nT": "commented-wrapper", "/* a": "unbalanced-quote", 'T | where p == @"C:\\"': None, "": "empty", 'print "a"': None, "// a\n": "no-result", "// head\n| where a": "leading-pipe",
    "externaldata(V:string))[h'https://e.test']": "unbalanced-delimiter", "DeviceEvents | take 10;": None, "let f = () { T; U }; f()": None, "```kql\nT": "code-fence", "T | where a == ```x ' y```\n| take 1": None, "T | where b == '([' ": None,
    "set q = ago(1h);\n...": "placeholder", "x" * 100_001: "too-long",
}


def test_structure(spark):
    assert column(spark, list(STRUCTURE), query_text.structural_problem) == list(STRUCTURE.values())


def test_deep_and_long_texts_cost_one_pass(spark):
    deep = "T | where " + "([{" * 14_000 + "}])" * 14_000
    assert column(spark, [deep, deep[:-1], "T | where a == '" + "x\\\\" * 30_000 + "'", "T '" + "\\" * 90_001, "T\n" + "| where a\n" * 9000], query_text.structural_problem) == [None, "unbalanced-delimiter", None, "unbalanced-quote", None]


TABLES = {
    'arg("").authorizationresources | take 10': ["authorizationresources"], "WindowsEvent('Application', 7d)\n| where 1": ["WindowsEvent"], "let r = FileInfo('C:\\\\Windows\\\\*'); r": ["FileInfo"],
    'DeviceInfo\n| project DeviceId,\n    Name\n| join hint.remote=left kind=leftouter (\n    arg("").Procs\n    | project DeviceId\n) on DeviceId\n| project A': ["DeviceInfo", "Procs"],
    "let readEvents = () {\n    DeviceEvents\n    | where A == \"E\"\n};\nlet recent = materialize(\n    Files\n    | where T > ago(1d)\n);\nunion kind=outer\n    Net,\n    Procs\n| take 10": ["DeviceEvents", "Files", "Net", "Procs"],
    "union\n    (\n        SigninLogs\n    )\n| take 10": ["SigninLogs"], "union isfuzzy=true A, B": ["A", "B"], "T | union p=v A, b*, f(x), a": ["T", "A", "b*"],
    'let f = (t: string, e: string) {\n    table(t)\n    | where U == e\n};\nf("SigninLogs", "x")\n| union f("Other", "x")': ["SigninLogs", "Other"], 'let f = (t: string) { table(t) };\nlet r = "S";\nf(r)': [],
    "SigninLogs // c\n| where x == 1": ["SigninLogs"], "search in (A, B*) 'x'": ["A", "B*"], "let a = Src;\na | lookup Other on x | lookup g(1) on y | join kind=inner (a) on z": ["Src", "Other"], "table('Lit') | take 1": ["Lit"], "T | where x == @\"C:\\\" | join (U) on k": ["T", "U"],
}


def test_tables(spark):
    got = column(spark, list(TABLES), query_text.source_tables)
    assert [sorted(x, key=str.lower) for x in got] == [sorted(x, key=str.lower) for x in TABLES.values()]


def test_dialects_and_defaults(spark):
    rows = spark.createDataFrame([(["AuthorizationResources"], "sentinel"), (["x"], "sentinel"), (["resources"], "intune-device-query"), ([], "azure-resource-graph")], "t array<string>, d string")
    got = rows.select(query_text.inferred_dialect(F.col("t"), F.col("d")).alias("d"), query_text.default_tables(F.col("t"), F.col("d")).alias("t")).collect()
    assert [r["d"] for r in got] == ["azure-resource-graph", "sentinel", "intune-device-query", "azure-resource-graph"] and got[3]["t"] == ["Resources"]


POLICY = {
    " \n// only": "KQL_EMPTY", "```kql\nT | take 1\n```": "KQL_MARKDOWN_NOT_ALLOWED", "# head": "KQL_MARKDOWN_NOT_ALLOWED", '{"query":"T"}': "KQL_JSON_NOT_ALLOWED", "SELECT * FROM S": "KQL_SQL_NOT_ALLOWED", "drop table x": "KQL_SQL_NOT_ALLOWED",
    "curl https://x": "KQL_SHELL_NOT_ALLOWED", "<script>a": "KQL_HTML_NOT_ALLOWED", "YOUR_TABLE | take 1": "KQL_PLACEHOLDER_NOT_ALLOWED", "T | take 1": None, 'print l = "${VALUE}", v = @"{{VALUE}}"': None, "// c\nT \x01": "KQL_CONTROL_CHARACTER",
    "selection | take 1": None, "gitlogs | take 1": None, "x" * 100_001: "KQL_QUERY_TOO_LARGE", "T // TODO": None, "T | where a == TODO": "KQL_PLACEHOLDER_NOT_ALLOWED",
}


def test_policy(spark):
    got = column(spark, list(POLICY), query_text.policy_failure)
    assert [g and g["code"] for g in got] == list(POLICY.values())
    assert tuple(got[11][c] for c in ("start", "length", "line", "col")) == (7, 1, 2, 3)


def test_dialect_diagnostics(spark):
    graph = "R\n| join kind=rightanti hint.strategy=shuffle (S | project-reorder a) on id\n| mv-expand v limit 2001\n| limit 5000\n| evaluate x()\n| join kind=inner (union kind=outer A, B) on id"
    many = "R\n" + "| render x\n" * 25
    rows = spark.createDataFrame([("a", graph, "azure-resource-graph"), ("b", many, "intune-device-query"), ("c", graph, "sentinel"), ("d", "select 1 from x", "azure-resource-graph"), ("e", "print 1; datatable(a:int)[1] | take 1", "intune-device-query"), ("f", None, "azure-resource-graph")], "k string, b string, d string")
    got = [tuple(r) for r in diagnostics.diagnostics(rows, "k", "b", "d").orderBy("k", "place").select("k", "place", "code", "start", "length", "line", "col").collect()]
    at = lambda x: graph.index(x)
    assert got[:5] == [
        ("a", 1, "KQL_ARG_JOIN_KIND_NOT_SUPPORTED", at("rightanti"), 9, 2, 13), ("a", 2, "KQL_ARG_JOIN_STRATEGY_NOT_SUPPORTED", at("hint"), len("hint.strategy=shuffle"), 2, 23),
        ("a", 3, "KQL_DIALECT_OPERATOR_NOT_SUPPORTED", at("project-reorder"), 15, 2, at("project-reorder") - 1), ("a", 4, "KQL_ARG_MV_EXPAND_LIMIT", at("2001"), 4, 3, 21), ("a", 5, "KQL_DIALECT_OPERATOR_NOT_SUPPORTED", at("evaluate"), 8, 5, 3),
    ]
    assert [g[:3] for g in got[5:] if g[0] == "b"][-2:] == [("b", 19, "KQL_DIALECT_OPERATOR_NOT_SUPPORTED"), ("b", 20, "KQL_DIAGNOSTICS_TRUNCATED")] and sum(g[0] == "b" for g in got) == 20
    assert [g[0] for g in got if g[0] in "cdef"] == ["d", "e", "e"]


@pytest.mark.parametrize("f, plain", [(t.first_spelling, lambda w: [w[[x.lower() for x in w].index(k)] for k in dict.fromkeys(x.lower() for x in w)]), (t.last_spelling, lambda w: list({x.lower(): x for x in w}.values()))])
def test_spellings(spark, f, plain):
    r = random.Random(3)
    lists = [[], ["a"]] + [[r.choice("aAbBcCdD") for _ in range(n)] for n in range(1, 30)] + [[f"{r.choice('xX')}{k % 900}" for k in range(20_000)]]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(lists)], "i int, w array<string>")
    got = {r["i"]: r["x"] for r in rows.select("i", f(F.col("w")).alias("x")).collect()}
    assert [got[i] for i in range(len(lists))] == [plain(w) for w in lists]
