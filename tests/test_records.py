"""Import plans, whole records and the search service on small inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from grainmill.operators import manifest, records, retrieval, search_service
from grainmill.operators.request import Request

ROW = "upstream_source_url string, upstream_repository string, repository_default_branch string, repository_license_spdx string, ingestion_license_status string"


def _rows(spark, *rows):
    return spark.createDataFrame([(*r, "ok") if len(r) == 4 else r for r in rows], ROW)


def test_source_paths(spark):
    cases = {
        ("https://github.com/Own/Name/blob/main/a/b.kql", "own/name", "main"): ("a/b.kql", None),
        ("HTTPS://GitHub.com:443/own//name/blob/rel/v2/a%20b%2Fc+d.md?plain=1#L3", "OWN/NAME", "rel/v2"): ("a b/c+d.md", None),
        ("https://github.com/own/name/blob/rel/v3/a.md", "own/name", "rel/v2"): (None, "branch"),
        ("https://github.com/own/name/blob/rel", "own/name", "rel/v2"): (None, "branch"),
        ("https://github.com/own/name/blob/main/", "own/name", "main"): (None, "no-path"),
        ("https://github.com/own/name/tree/main/a.md", "own/name", "main"): (None, "repository"),
        ("https://github.com/own/other/blob/main/a.md", "own/name", "main"): (None, "repository"),
        ("https://github.com", "own/name", "main"): (None, "repository"),
        ("https://github.com/own/name/blob/main/%zz", "own/name", "main"): (None, "encoding"),
        ("http://github.com/own/name/blob/main/a.md", "own/name", "main"): (None, "unsupported-url"),
        ("https://github.com.evil.example/own/name/blob/main/a.md", "own/name", "main"): (None, "unsupported-url"),
        ("https://evil.example/?https://github.com/own/name/blob/main/a.md", "own/name", "main"): (None, "unsupported-url"),
        (None, "own/name", "main"): (None, "unsupported-url"),
        ("https://github.com/own/name/blob/main/a.md", None, "main"): (None, "repository"),
        ("https://github.com/own/name/blob/main/a.md", "own/name", None): (None, "branch"),
        ("https://github.com/own/name/blob/main/" + "d/" * 500 + "a.md", "own/name", "main"): ("d/" * 500 + "a.md", None),
    }
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], "i int, u string, r string, b string")
    got = df.select("i", manifest.source_path(F.col("u"), F.col("r"), F.col("b")).alias("s")).orderBy("i").collect()
    assert [tuple(r["s"]) for r in got] == list(cases.values())


def test_plans(spark):
    at = "https://github.com/a/b/blob/main/"
    fine = [(at + "x.md", "a/b", "main", "MIT"), (at + "x.md", "A/b", "main", "MIT"), (at + "y.md", "a/B", "main", "MIT"), ("https://github.com/c/d/blob/dev/z.md", "c/d", "dev", "ISC")]
    skipped = ("no address", "e/f", "main", "GPL-3.0", "refused")
    found, paths = manifest.planned(_rows(spark, *fine, skipped), "ok")
    assert [tuple(r) for r in found.collect()] == [("a/b", "A/b", "main", "MIT", 2, None), ("c/d", "c/d", "dev", "ISC", 1, None)]
    assert {tuple(r) for r in paths.collect()} == {("a/b", "x.md"), ("a/b", "y.md"), ("c/d", "z.md")}
    for row, why in (((at + "w.md", "a/b", "main", "ISC"), "inconsistent"), ((at + "w.md", "a/b", "main", None), "incomplete"), (("https://x.example/a", "a/b", "main", "MIT"), "unsupported-url")):
        with pytest.raises(ValueError, match=why):
            manifest.planned(_rows(spark, *fine, row), "ok")
    with pytest.raises(ValueError, match="license"):
        manifest.planned(_rows(spark, ("https://github.com/g/h/blob/main/a", "g/h", "main", "GPL-3.0")), "ok")
    none, paths = manifest.planned(_rows(spark, skipped), "ok")
    assert none.count() == 0 and paths.count() == 0


def test_provenance_needs_all_parts(spark):
    names = [*records.PARTS, "repository_source_url", "provider", "trusted", "required_notice"]
    whole = [*"abcdefg", None, None, None, None]
    rows = [whole] + [[v if i != k else bad for i, v in enumerate(whole)] for k in range(7) for bad in (None, "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} {'boolean' if n == 'trusted' else 'string'}" for n in names))
    got = [r["p"] for r in df.select("i", records.whole_provenance().alias("p")).orderBy("i").collect()]
    assert got[0]["trusted"] is False and got[0]["required_notice"] == "" and got[0]["repository_url"] is None
    assert got[1:] == [None] * 14


HIT = "query_id string, version_id string, title string, tables array<string>, score double, star_count long"


def _stages(spark, score=0.3, fail=(), seen=None):
    hits = spark.createDataFrame([("1", "1-v1", "One", ["t"], score, 4), ("2", "2-v1", "Two", [], 0.2, 0)], HIT)

    def stage(name, rows):
        def run(*args):
            (seen if seen is not None else []).append((name, *args))
            return rows(*args)

        return run

    def broken(df, name):  # fails when Spark evaluates it, as a lost store would
        return df.withColumn("score", F.raise_error(F.lit(name)).cast("double")) if name in fail else df

    def semantic(name, vector, limit):
        ids = [("1", "1-v1", 0.9), ("3", "3-v1", 0.8), ("4", "4-old", 0.99)] if name == "public" else [("5", "5-v1", 0.6), ("1", "1-v1", 0.1)]
        return broken(spark.createDataFrame(ids, "query_id string, version_id string, score double"), name)

    def authorised(ids):
        rows = spark.createDataFrame([("1", "1-v1", "One", ["t"], 4), ("3", "3-v1", "Three", [], 1), ("4", "4-v2", "Four", [], 1), ("5", "5-v1", "Five", [], 0)], HIT.replace("score double, ", ""))
        rows = rows.join(ids, "query_id", "left_semi")
        return rows.withColumn("title", F.raise_error(F.lit("no"))) if "authorised" in fail else rows

    def embed(text):
        if "embed" in fail:
            raise TimeoutError
        return [1.0]

    def intent(request):
        if "intent" in fail:
            raise TimeoutError
        return {"query": "meant", "concepts": ["more"], "dialect": "sentinel", "dialect_confidence": 0.9}

    return search_service.Stages(stage("lexical", lambda r: broken(hits, "lexical")), stage("embed", embed), stage("semantic", semantic), stage("authorised", authorised), stage("intent", intent))


def _page(outcome):
    return {r["query_id"]: (r["match_type"], round(r["score"], 4)) for r in outcome.results.collect()}


def test_adequate_hits_end_the_search(spark):
    seen = []
    got = search_service.search(Request("words", limit=1), 7, _stages(spark, 0.9, seen=seen))
    assert (got.mode, got.attempted, got.issues, got.fallback, got.intent) == ("lexical", ("lexical",), (), None, None)
    assert _page(got) == {"1": ("lexical", 0.9)} and [s[0] for s in seen] == ["lexical"]


def test_merged_outcome(spark):
    seen = []
    got = search_service.search(Request("words"), 7, _stages(spark, seen=seen))
    # the first namespace's score of 1 counts; 4 has another version by now
    assert _page(got) == {"1": ("hybrid", round(0.3 * 0.62 + 0.9 * 0.38 + 0.06, 4)), "2": ("lexical", 0.2), "3": ("semantic", 0.8), "5": ("semantic", 0.6)}
    assert got.mode == "hybrid" and got.issues == () and got.attempted == ("lexical", "intent", "embedding", "semantic", "authorization")
    assert got.fallback is None and got.adequacy["reason"] == "strong-score"
    assert ("embed", "meant more") in seen and [s[1] for s in seen if s[0] == "semantic"] == ["public", "private:7"] and {s[3] for s in seen if s[0] == "semantic"} == {40}


@pytest.mark.parametrize(
    "fail, codes, page, reason",
    [
        (("intent",), ["intent_extraction_failed"], {"1", "2", "3", "5"}, None),
        (("embed",), ["embedding_failed"], {"1", "2"}, "retrieval-incomplete"),
        (("public",), ["semantic_search_failed"], {"1", "2", "5"}, "retrieval-incomplete"),
        (("private:7",), ["semantic_search_failed"], {"1", "2", "3"}, None),
        (("public", "private:7"), ["semantic_search_failed"], {"1", "2"}, "retrieval-incomplete"),
        (("authorised",), ["authorization_check_failed"], {"1", "2"}, "retrieval-incomplete"),
    ],
)
def test_degraded_outcomes(spark, fail, codes, page, reason):
    got = search_service.search(Request("words"), 7, _stages(spark, fail=fail))
    assert [i.code for i in got.issues] == codes and set(_page(got)) == page
    assert (got.fallback and got.fallback.reason) == reason
    if reason:
        assert got.fallback.status == "unavailable" and got.fallback.dialect_required == ("intent" in fail)
    assert all(i.recoverable == (i.stage != "authorization") for i in got.issues)


def test_no_search_without_hits(spark):
    with pytest.raises(search_service.SearchUnavailable):
        search_service.search(Request("words"), None, _stages(spark, fail=("lexical",)))


def test_only_own_namespaces():
    assert retrieval.namespaces(None) == ["public"]
