"""Titles, descriptions and tags on known cases; unique names against a walk in order."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from grainmill.functions import query_text
from grainmill.operators import enrichment

ROW = "path string, title string, body string, description string, dialect string"


def enriched(spark, *rows):
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "i string, " + ROW)
    df = df.withColumns({"tables": query_text.source_tables(F.col("body")), "operators": query_text.pipe_operators(F.col("body"))})
    return enrichment.enriched(df).orderBy(F.col("i").cast("int")).collect()


def test_known_titles(spark):
    isolate = 'CloudAppEvents\n| where ActionType == "IsolateDevice"\n| take 10'
    got = enriched(
        spark,
        ("Azure Active Directory/MonitorCloudBreakGlassAccount.md", "Defender XDR", 'AADSignInEventsBeta\n| where AccountDisplayName == "Emergency Admin"', "", "defender-xdr"),
        ("WindowsEvent/Show Application Hangs.kql", "Show Application Hangs", "WindowsEvent('Application', 7d)\n| where tostring(EventId) == '1002'", "Monitoring application hang events in systems.", "intune-device-query"),
        ("WindowsDriver/Unsigned Drivers.kql", "Unsigned Drivers", "// Description: Finds unsigned drivers on the device.\nWindowsDriver\n| where Signed != true", "", "intune-device-query"),
        ("Azure Resource Graph/Functions/AzureTagSearch.md", "Log Analytics (Sentinel)", 'Resources | where tags contains "production"', "", "azure-resource-graph"),
        ("Defender XDR/Linux - Network fan‑out from the upload process.md", "Follow‑up pivots (recommended)", "DeviceNetworkEvents | project RemoteIP", "", "defender-xdr"),
        ("Defender For Endpoint/nf_ttp_generic_kerberos_attacks.md", "Common Rubeus command lines", "T | take 1", "", "defender-xdr"),
        ("Identity/SuccessfulDeviceCodeAuthenticationUnmanagedDevice.md", "Microsoft Sentinel / 365 Defender 3", "SigninLogs | take 10", "", "sentinel"),
        ("Defender/MDE-DefenderEngine.md", "Microsoft 365 Defender 5", "// Update rings\nDeviceTvmInfoGathering\n| project DeviceName, AvEngineRing", "", "defender-xdr"),
        ("Defender For Endpoint/MDE-Audit.md", "Defender XDR 2", isolate, "", "defender-xdr"),
        ("queries/README.md", "KQL", "T | take 1", "", "sentinel"), ("Browser/docs/README.md", "Query", "T | take 1", "", "sentinel"), ("query.kql", "", "T | summarize count() by bin = DeviceId", "", "sentinel"),
    )
    assert [r["title"] for r in got] == [
        "Monitor Cloud Break Glass Account - Defender XDR", "Show Application Hangs", "Unsigned Drivers", "Search Azure Resources by Tag", "Trace Linux Upload Process Network Fan-Out", "Common Rubeus command lines",
        "Successful Device Code Authentication Unmanaged Device - Microsoft Sentinel and Defender XDR", "Update rings - Defender XDR", "MDE Audit: Find Isolate Device events - Part 2 - Defender XDR", "T query", "Browser - Microsoft Sentinel",
        "Summarize T by Device Id",
    ]
    assert got[0]["description"] == "Monitors cloud Break Glass Account from AADSignInEventsBeta." and got[2]["description"] == "Finds unsigned drivers on the device."
    assert {"defender-xdr", "aad-sign-in-events-beta", "authentication"} <= set(got[0]["tags"]) and {"intune", "windows-event", "application-hang", "event-id-1002", "single-device"} <= set(got[1]["tags"])
    assert got[5]["tags"] == ["defender-xdr", "t"] and all(len(set(r["tags"])) == len(r["tags"]) <= 12 for r in got)


DESCRIBED = {
    "// Title\n// more of it\n\n// later\nT": "Title more of it", "T\n// after": "after", "// Author: x\n// Purpose: find\n// all of\n// Severity: high\n// no\nT": "find all of",
    "// Use case:\n// first\n//\n// second\nT": "first", "// Description: a\n\n// b\nT": "a b", "": "", "// ===x\n// real": "real", "//\n// x": "x", "\n\n// y\nT": "y",
}


def test_descriptions_from_comments(spark):
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(DESCRIBED)], "i int, b string")
    got = [r["d"] for r in rows.select("i", enrichment.comment_description(F.col("b")).alias("d")).orderBy("i").collect()]
    assert got == list(DESCRIBED.values())


def test_titles_from_intent(spark):
    cases = [
        ("T | where Type == 'microsoft.compute/virtualMachines'", "List virtual Machines resources"), ("T | where tostring(Operation) =~ \"Add member\"", "Find Add member events"), ("SigninLogs | where AppName has 'x y'", "Filter Signin Logs by App Name"),
        ("T | where a == 1 | distinct $x1, b", "List distinct $x1"), ("T | summarize count(), x by bin_ = Device_Id, c", "Summarize T by Device Id"), ("T | take 1", None), ("T | where a == 'b\" | distinct c", "List distinct c"),
    ]
    rows = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(cases)], "i int, b string")
    got = rows.select("i", enrichment.intent_title(F.col("b"), query_text.source_tables(F.col("b"))).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in got] == [t for _, t in cases]


def walked(rows):
    """Names in order, one after the other."""
    used, out = set(), {}
    for repo, path, block, title, body in sorted(rows, key=lambda r: r[:3]):
        name, part = title, block + 1
        while (repo, name.lower()) in used:
            tail = (re.search(enrichment.QUALIFIER.replace("\\z", r"\Z"), title) or [""])[0]
            base = re.sub(r"(?i)\s+-\s+Part\s+\d+\Z", "", title[: len(title) - len(tail)])
            detail = body[3:].split("\n")[0] if body.startswith("// ") else ""
            head = f"{base}: {detail}" if detail and detail.lower() != base.lower() else base
            end = f" - Part {part}{tail}"
            name, part = head[: max(1, 180 - len(end))].rstrip() + end, part + 1
        used.add((repo, name.lower()))
        out[repo, path, block] = name
    return out


@pytest.mark.parametrize("seed", range(3))
def test_unique_names_against_a_walk(spark, seed):
    r = random.Random(seed)
    titles = ["Logins", "logins", "Logins - Part 2", "Logins - Defender XDR", "LOGINS - Part 3 - Defender XDR", "Failed logins: Detail here", "x" * 179, "x" * 180, "Other"]
    keys = {(r.choice("rs"), f"p{r.randrange(40)}", r.randrange(4)) for _ in range(200)}
    rows = [(*k, r.choice(titles[: 3 + 3 * seed]), r.choice(["T | take 1", "// Detail here\nT", "// Logins\nT"])) for k in sorted(keys)]
    df = spark.createDataFrame(rows, "repository string, path string, block long, title string, body string").withColumn("tables", F.array().cast("array<string>")).repartition(5)
    got = enrichment.unique_titles(df).collect()
    assert {(x["repository"], x["path"], x["block"]): x["title"] for x in got} == walked(rows)


def test_many_equal_names_take_few_rounds(spark):
    rows = spark.range(3000).select(F.lit("r").alias("repository"), F.lpad(F.col("id").cast("string"), 5, "0").alias("path"), (F.col("id") % 3).alias("block"), F.lit("Same").alias("title"), F.lit("T").alias("body"), F.array().cast("array<string>").alias("tables"))
    got = enrichment.unique_titles(rows, most_rounds=12).select("title").distinct().count()
    assert got == 3000
