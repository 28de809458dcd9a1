"""Work that must not grow with the number of rules, stages or tokens of a text; one test for each finding of the third round."""

from __future__ import annotations

from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from grainmill.functions import lexer
from grainmill.operators import diagnostics, enrichment, retrieval
from grainmill.sources import corpus
from grainmill.streaming import leases


def told(spark, column) -> str:
    return spark.range(1).select(column.alias("x"))._jdf.queryExecution().analyzed().toString()


def test_tables_are_computed_once_for_tags(spark):
    """tables and operators come as expressions over the text; each stands once in the tags' expression."""
    none = F.lit("")
    plan = told(spark, enrichment.derived_tags(F.lit("sentinel"), none, none, none, F.lit("T"), F.split(F.lit("Aaa,Bbb"), ","), F.split(F.lit("join;take"), ";")))
    assert plan.count("split(Aaa,Bbb") == 1 and plan.count("split(join;take") == 1


def test_dense_masks_tell_what_masks_tell(spark):
    """Rules see masks whose comments and strings are one sign a line; what they find is the same, and the masks are short."""
    texts = ["T // a 'b'\n\n// c\n| where x == 'p;q' /* r\n s */ and y", "let a = 'x", "", "/* open", "a\r// b\rc | d @'e'", "``` f\n g ``` h\t\t\n \n \n i.", "'it''s' \"q\\\"r\"", "/", "x //", "~~~ s"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t, dense, plain = F.col("t"), lexer.dense_masks(F.col("t")), lexer.masks(F.col("t"))
    lean = lambda c: F.regexp_replace(F.regexp_replace(c, '"+', '"'), "\\s+", " ")
    got = rows.select("i", (dense["closed"] == lexer.all_closed(t)).alias("closed"), *((lean(dense[k]) == lean(plain[k])).alias(k) for k in ("code", "blank", "quoted"))).collect()
    assert len(got) == len(texts) and all(r["closed"] and r["code"] and r["blank"] and r["quoted"] for r in got), got
    long = rows.limit(1).select(F.concat(F.repeat(F.lit("// a row of words\n"), 5000), F.lit("T | take 1")).alias("t"))
    assert long.select(F.length(lexer.dense_masked(F.col("t"))).alias("n")).first()["n"] < 20


def test_comment_titles_may_be_generic_and_hold_separators(spark):
    """the SQL knows no generic titles; a line separator is no end of a comment."""
    rows = spark.createDataFrame([("// Defender XDR\nT",), ("// a b c d\nT",)], "b string")
    assert [r[0] for r in rows.select(enrichment.comment_title(F.col("b"), generic=True)).collect()] == ["Defender XDR", "a b c d"]
    assert rows.select(enrichment.comment_title(F.col("b"))).first()[0] is None


def test_terms_of_the_index_are_not_shuffled_before_they_are_stored(spark, sf):
    """a document's terms are weighed in its row; the sum is what rows of single tokens give."""
    docs = retrieval.index_documents(corpus.documents(spark, sf))
    terms = retrieval.weighed_terms(docs)
    assert "hashpartitioning" not in terms._jdf.queryExecution().executedPlan().toString()
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in retrieval.WEIGHTS.items() for x in kv)), F.col("field"))
    single = retrieval.postings(docs).groupBy("term", "doc_id").agg(F.sum(weight * F.col("tf")).alias("weight"), F.sum("tf").alias("tf"))
    assert terms.select("term", "doc_id", "weight", "tf").exceptAll(single).isEmpty() and terms.count() == single.count()


def test_texts_stay_out_of_the_join_with_labels(spark, sf):
    """a head's status needs the text's length only, and that is measured below the join."""
    rows = corpus.labelled(corpus.documents(spark, sf), spark, sf).select("doc_id", "moderation_status")
    above, _, below = rows._jdf.queryExecution().optimizedPlan().toString().partition("Join LeftOuter")
    assert "length(" in below and "length(" not in above


def test_tokens_beyond_one_batch(spark):
    """F16: tokens leave a worker by batches; none is lost or doubled at their borders, and further columns stay with their text."""
    n = lexer.BATCH + 7
    rows = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, ";" * n, "z"), (4, "b c", "w")], "i int, t string, d string")
    got = lexer.lexemes(rows, "i", "t", names=True, also=["d"]).groupBy("i", "d").agg(F.count_distinct("start").alias("n")).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(1, "x", 1), (3, "z", n), (4, "w", 2)]


def test_diagnostics_join_nothing(spark, sf):
    """what the rows of a text need travels with its tokens, and a text and its policy are made once in each branch."""
    rows = corpus.documents(spark, sf).select("query_id", "dialect", F.upper("kql").alias("body"))
    plan = diagnostics.diagnostics(rows, "query_id", "body", "dialect")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("upper(") == 2


def test_jobs_without_moves_make_no_frame():
    """most events move nothing, so they give no rows."""
    state = SimpleNamespace(exists=False, hasTimedOut=False, getCurrentWatermarkMs=lambda: 0, update=lambda s: None, remove=lambda: None, setTimeoutTimestamp=lambda at: None)
    assert list(leases._moves((1,), iter([pd.DataFrame({"kind": ["failed"], "at_ms": [5]})]), state)) == []


def test_postings_are_counted_as_columns(spark):
    """terms are counted as Arrow columns, 2,000 fields at a time, not by lambdas over every token; null texts, accents and the borders of the 2,000 count right."""
    texts = ["Été ete x_y x", None, "", "a a\nA 中文 ½ ß", "..."] * 500
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, kql string").coalesce(1)
    docs = rows.select("doc_id", "kql", *(F.lit("A b").alias(f) if f == "title" else F.lit(None).cast("string").alias(f) for f in retrieval.WEIGHTS if f != "kql"))
    got = retrieval.postings(docs)
    assert "transform(" not in got._jdf.queryExecution().optimizedPlan().toString()
    terms = {0: {"ete": 2, "x": 2, "y": 1}, 3: {"a": 3, "中文": 1, "½": 1, "ß": 1}}
    want = {(i, "kql", t, n) for i in range(len(texts)) for t, n in terms.get(i % 5, {}).items()} | {(i, "title", t, 1) for i in range(len(texts)) for t in "ab"}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want


def test_tags_are_found_with_tables(spark, sf):
    """a text is searched once for tables and tags; tags are the tables of 10 letters or more."""
    docs = corpus.documents(spark, sf)
    both = docs.select("tables", "tags")
    assert both._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    own = F.sort_array(F.array_distinct(F.regexp_extract_all(F.lower("kql"), F.lit("[a-z]{10,}"), F.lit(0))))
    assert docs.where(~own.eqNullSafe(F.col("tags"))).isEmpty() and not docs.where(F.size("tags") > 0).isEmpty()
