"""Titles, descriptions and tags of imported queries, and names that are unique in a repository.

Titles and descriptions are column expressions: comment blocks are folds over at most 100 lines. Names are settled by rounds of
proposals over the whole repository, see ``unique_titles``.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.functions import text as t
from grainmill.functions.lexer import bound
from grainmill.functions.query_text import strip
from grainmill.operators.ingest import event_tags, fallback_description, normalized_description, technique_tags
from grainmill.sources.scratch import new_folder, remove

# ---- fixed values
DIALECT_LABELS = {
    "sentinel": "Microsoft Sentinel", "defender-xdr": "Defender XDR", "azure-data-explorer": "Azure Data Explorer", "azure-resource-graph": "Azure Resource Graph",
    "intune-device-query": "Intune Device Query",
}
DIALECT_TAGS = {"sentinel": "sentinel", "defender-xdr": "defender-xdr", "azure-data-explorer": "azure-data-explorer", "azure-resource-graph": "azure-resource-graph", "intune-device-query": "intune"}
#: Generic headings whose purpose the file tells: (path, heading, title).
PURPOSES = [
    ("Azure Resource Graph/Functions/AzureResourceCount.md", "Log Analytics (Sentinel)", "Count Azure Resources by Subscription"),
    ("Azure Resource Graph/Functions/AzureTagSearch.md", "Log Analytics (Sentinel)", "Search Azure Resources by Tag"),
    ("Azure Resource Graph/Functions/ListPublicIPs.md", "Log Analytics (Sentinel)", "List Assigned Azure Public IP Addresses"),
    ("Defender For Endpoint/nf_ttp_generic_kerberos_attacks.md", "Microsoft Defender Antivirus Detections", "Find Kerberos Overpass-the-Hash Alerts"),
    ("Defender For Endpoint/nf_ttp_smoke-sandstorm_unusual_coreuicomponent.dll-behaviour.md", "Microsoft Defender Antivirus Detections", "Find Smoke Sandstorm DLL Hijacking Alerts"),
    ("Defender XDR/Linux - Network fan-out from the upload process.md", "Follow-up pivots (recommended)", "Trace Linux Upload Process Network Fan-Out"),
    ("Defender XDR/Linux - User activity leading up to exfiltration.md", "Follow-up pivots (recommended)", "Review Linux User Activity Before Exfiltration"),
]
ACTION_FIELDS = "actiontype activitytype eventtype operation operationname recordtype".split()
QUALIFIER = "(?i)\\s+-\\s+(?:Microsoft Sentinel(?: and Defender XDR)?|Defender XDR|Azure Data Explorer|Azure Resource Graph|Intune Device Query)\\z"
MOST_TITLE = 180

_NAME = "[A-Za-z_][A-Za-z0-9_]*"
_SIDE_NOTE = "(?i)\\A(?:(?:{words})(?![A-Za-z0-9_])|(?:https?://|={{3,}}|-{{3,}})(?=[A-Za-z0-9_]))"
_ORDINAL = "\\s*(?:#|[-:])?\\s*(\\d+)\\z"
#: Line separators other than LF and CR are part of a comment.
_COMMENT = "(?s)\\A\\s*//+\\s?(.*)\\z"


def _has(value: Column, pattern: str) -> Column:
    return F.rlike(value, F.lit(pattern))


def clean_text(value: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(value, "[*_`~]", ""), "\\s+", " "))


def humanized(value: Column) -> Column:
    """An identifier as words: parted at case, underscores and hyphens."""
    parted = F.regexp_replace(F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return clean_text(F.regexp_replace(parted, "[_-]+", " "))


def normalized_tag(value: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(humanized(value)), "[^a-z0-9]+", "-"), "\\A-+|-+\\z", ""), 1, 64)


def is_generic(title: Column) -> Column:
    return t.is_generic_title(F.regexp_replace(clean_text(title), "\\p{Pd}", "-"))


def _label(dialect: Column) -> Column:
    return F.coalesce(*(F.when(dialect == d, F.lit(v)) for d, v in DIALECT_LABELS.items()))


def _filled(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


# ---- from comments


def _lines(body: Column, most: int) -> Column:
    return F.slice(F.split(F.regexp_replace(body, "\\r\\n?", "\n"), "\n", -1), 1, most)


def comment_title(body: Column, generic: bool = False) -> Column:
    """The first of the leading comment lines that can be a title, or null; with ``generic``, names of products and filler words can be one too."""
    side = _SIDE_NOTE.format(words="author|copyright|data\\s+connector|source|spdx")

    def title(line: Column) -> Column:
        said = strip(F.regexp_extract(line, _COMMENT, 1))
        return clean_text(F.regexp_replace(F.regexp_replace(said, "(?i)\\A(?:title|query|name|description|purpose|use\\s*case)\\s*:\\s*", ""), "[.:;]+\\z", ""))

    def of(lines: Column) -> Column:
        code = F.array_position(F.transform(lines, lambda x: ~_has(x, _COMMENT)), True)
        titles = F.transform(F.when(code > 0, F.slice(lines, F.lit(1), (code - 1).cast("int"))).otherwise(lines), title)
        fine = lambda x: F.length(x).between(5, 120) & ~_has(x, side) & ~_has(x, "(?i)\\Athis\\s+query(?![A-Za-z0-9_])") & (F.lit(generic) | ~is_generic(x))
        return F.get(F.filter(titles, fine), F.lit(0))

    return bound(F.filter(_lines(body, 30), lambda x: strip(x) != ""), of)


def comment_description(body: Column) -> Column:
    """What follows a description label in the comments, up to a blank or another label; without a label, the leading comment paragraph."""
    side = _SIDE_NOTE.format(words="data\\s+connector|author|copyright|spdx|source")
    none = F.array().cast("array<string>")
    state = F.struct(F.lit(False).alias("done"), F.lit(False).alias("labelled"), none.alias("said"), none.alias("first"))

    def step(s: Column, line: Column) -> Column:
        blank, comment = strip(line) == "", _has(line, _COMMENT)
        text = strip(F.regexp_extract(line, _COMMENT, 1))
        label = "(?i)\\A(?:use\\s*case|purpose|description)\\s*:\\s*"
        labelled = comment & _has(text, label)
        other = "(?i)\\A(?:tables?|mitre|tactics?|techniques?|author|severity|rule|={3,}|-{3,})\\s*:?"
        begun = s["labelled"] | (F.size(s["first"]) > 0)
        stop = (blank & ~s["labelled"] & (F.size(s["first"]) > 0)) | (~blank & ~comment & begun) | (comment & ~labelled & s["labelled"] & ((text == "") | _has(text, other)))
        rest = F.regexp_replace(text, label, "")
        said = F.when(labelled & (rest != ""), F.concat(s["said"], F.array(rest))).when(comment & ~blank & ~labelled & s["labelled"], F.concat(s["said"], F.array(text))).otherwise(s["said"])
        first = F.when(comment & ~labelled & ~s["labelled"] & (text != "") & ~_has(text, side), F.concat(s["first"], F.array(text))).otherwise(s["first"])
        moved = F.struct(F.lit(False).alias("done"), (s["labelled"] | labelled).alias("labelled"), said.alias("said"), first.alias("first"))
        ended = F.struct(F.lit(True).alias("done"), s["labelled"].alias("labelled"), s["said"].alias("said"), s["first"].alias("first"))
        return F.when(s["done"], s).when(stop, ended).otherwise(moved)

    return F.array_join(F.aggregate(_lines(body, 100), state, step, lambda s: F.when(F.size(s["said"]) > 0, s["said"]).otherwise(s["first"])), " ")


# ---- from the query

#: Field (1) and value in quotes (2) of a filter, a distinct column, a grouping column.
FILTERED = f"(?i)\\|\\s*where\\s+(?:tostring\\s*\\(\\s*)?({_NAME})\\s*\\)?\\s*(?:==|=~|has|contains|startswith)\\s*@?('[^'\"\\r\\n]{{2,100}}'|\"[^'\"\\r\\n]{{2,100}}\")"
DISTINCT = "(?i)\\|\\s*distinct\\s+([A-Za-z_$][A-Za-z0-9_$]*)"
GROUPED = f"(?i)\\|\\s*summarize(?![a-z0-9_])[^|\\r\\n]*?(?<![a-z0-9_])by\\s+(?:{_NAME}\\s*=\\s*)?([A-Za-z_$][A-Za-z0-9_$]*)"


def intent_title(body: Column, tables: Column) -> Column:
    """What a query does, by its first filter on a text, else its distinct or grouping column; null if it has none."""
    field, value = F.regexp_extract(body, FILTERED, 1), F.substring(F.regexp_extract(body, FILTERED, 2), F.lit(2), F.length(F.regexp_extract(body, FILTERED, 2)) - 2)
    source = F.coalesce(humanized(F.get(tables, F.lit(0))), F.lit("events"))
    filtered = (
        F.when(F.lower(field).isin("type", "resourcetype"), F.concat(F.lit("List "), humanized(F.substring_index(value, "/", -1)), F.lit(" resources")))
        .when(F.lower(field).isin(ACTION_FIELDS), F.concat(F.lit("Find "), humanized(value), F.lit(" events"))).otherwise(F.concat(F.lit("Filter "), source, F.lit(" by "), humanized(field)))
    )
    return (
        F.when(_has(body, FILTERED), filtered).when(_has(body, DISTINCT), F.concat(F.lit("List distinct "), humanized(F.regexp_extract(body, DISTINCT, 1))))
        .when(_has(body, GROUPED), F.concat(F.lit("Summarize "), source, F.lit(" by "), humanized(F.regexp_extract(body, GROUPED, 1))))
    )


def improved_title(title: Column, path: Column, body: Column, dialect: Column, tables: Column, purposes: Sequence[tuple[str, str, str]] = PURPOSES) -> Column:
    """The title if it says something; else one from the file, a comment, the query or its folder, with the product that the heading names."""

    def key(value: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))

    candidate = clean_text(title)
    known = F.coalesce(*(F.when((key(path) == key(F.lit(p))) & (key(candidate) == key(F.lit(h))), F.lit(x)) for p, h, x in purposes), F.lit(None).cast("string"))
    ordinal = F.coalesce(F.when(_has(candidate, _ORDINAL), F.try_to_number(F.regexp_extract(candidate, _ORDINAL, 1), F.lit("9" * 15))).cast("long"), F.lit(1))
    ordinal = F.greatest(ordinal, F.lit(1))
    by_path = humanized(F.regexp_replace(F.element_at(F.split(path, "/"), -1), "(.)\\.[^.]*\\z", "$1"))
    comment, intent = comment_title(body), _filled(intent_title(body, tables))
    folders = F.filter(F.transform(F.reverse(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)), humanized), lambda x: (
        (x != "") & ~is_generic(x) & ~_has(x, "(?i)\\A(?:docs?|rules?|analytics|hunting|quer(?:y|ies))\\z")
    ))
    bare = F.regexp_replace(candidate, _ORDINAL, "")
    says = lambda p: _has(bare, f"(?i){p}")
    both = says("sentinel|log\\s+analytics"), says("defender|advanced\\s+hunting")
    qualifier = (
        F.when(says("references?|queries?|kql|kusto"), F.lit(None)).when(both[0] & both[1], "Microsoft Sentinel and Defender XDR").when(both[0], DIALECT_LABELS["sentinel"]).when(both[1], DIALECT_LABELS["defender-xdr"])
        .when(says("resource\\s+graph"), DIALECT_LABELS["azure-resource-graph"]).when(says("azure\\s+data\\s+explorer|(?<![a-z0-9_])(?:adx|fabric)(?![a-z0-9_])"), DIALECT_LABELS["azure-data-explorer"])
        .when(says("intune"), DIALECT_LABELS["intune-device-query"]).when(candidate != "", _label(dialect))
    )

    def made(x: Column) -> Column:
        numbered = F.concat(x["path"], F.lit(": "), x["intent"], F.lit(" - Part "), x["ordinal"].cast("string"))
        same = F.lower(clean_text(x["intent"])) == F.lower(clean_text(x["path"]))
        first = F.when(x["ordinal"] > 1, F.coalesce(x["comment"], F.when(x["intent"].isNotNull() & ~same, numbered), x["path"])).otherwise(x["path"])
        second = bound(first, lambda f: F.when(is_generic(f) | _has(f, "(?i)\\Areadme\\z"), F.coalesce(x["comment"], x["intent"], x["folder"])).otherwise(f))
        third = bound(second, lambda s: F.when(s.isNull() | (s == "") | is_generic(s), F.concat(F.coalesce(x["table"], x["label"]), F.lit(" query"))).otherwise(s))
        product = lambda s: F.when(x["qualifier"].isNotNull() & ~F.contains(F.lower(s), F.lower(x["qualifier"])), F.concat(s, F.lit(" - "), x["qualifier"])).otherwise(s)
        return bound(third, lambda s: F.substring(product(s), 1, MOST_TITLE))

    parts = F.struct(
        by_path.alias("path"), comment.alias("comment"), intent.alias("intent"), ordinal.alias("ordinal"), F.get(folders, F.lit(0)).alias("folder"), humanized(F.get(tables, F.lit(0))).alias("table"),
        _label(dialect).alias("label"), qualifier.alias("qualifier"),
    )
    return F.coalesce(known, F.when((candidate != "") & ~is_generic(candidate), F.substring(candidate, 1, MOST_TITLE)), bound(parts, made))


def derived_tags(dialect: Column, title: Column, description: Column, path: Column, body: Column, tables: Column, operators: Column) -> Column:
    """Dialect, four tables, topics, table families, event ids, techniques, then fillers while there are few; 12 at most.

    What is looked at many times is bound once: a caller may pass tables and operators as expressions over the text.
    """
    seen = F.struct(title.alias("title"), description.alias("description"), body.alias("body"), tables.alias("tables"), operators.alias("operators"))
    return bound(seen, lambda s: _tags(dialect, s["title"], s["description"], path, s["body"], s["tables"], s["operators"]))


def _tags(dialect: Column, title: Column, description: Column, path: Column, body: Column, tables: Column, operators: Column) -> Column:
    names = F.filter(F.transform(F.slice(tables, 1, 4), normalized_tag), lambda x: (x != "") & (x != "resources"))
    about = F.concat_ws(" ", title, description, humanized(path), F.array_join(F.transform(tables, humanized), " "))
    own = F.coalesce(*(F.when(dialect == d, F.lit(v)) for d, v in DIALECT_TAGS.items()))
    device = F.when((dialect == "intune-device-query") & F.exists(tables, lambda x: _has(x, "(?i)\\A(?:FileInfo|WindowsEvent|WindowsRegistry)\\z")), F.array(F.lit("single-device"))).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(F.array(own), names, t.matched_rules(about, t.TOPIC_RULES, "(?i)"), t.matched_rules(F.array_join(tables, " "), t.CATEGORY_RULES, "(?i)")))
    every = F.array_distinct(F.concat(every, F.array_distinct(event_tags(body)), F.array_distinct(technique_tags(body)), device))
    more = lambda tags, few, when, tag: F.when((F.size(tags) < few) & when, F.array_distinct(F.concat(tags, F.array(F.lit(tag))))).otherwise(tags)
    joined = bound(every, lambda x: more(x, 3, F.array_contains(operators, "join"), "correlation"))
    grouped = bound(joined, lambda x: more(x, 3, F.array_contains(operators, "summarize"), "aggregation"))
    return F.slice(bound(grouped, lambda x: more(x, 2, F.lit(True), "community-query")), 1, 12)


def enriched(rows: DataFrame) -> DataFrame:
    """Better title, description and tags. rows: path, title, body, description, dialect, tables, operators (and others, which stay)."""
    titled = rows.withColumn("title", improved_title(F.col("title"), F.col("path"), F.col("body"), F.col("dialect"), F.col("tables")))
    subject = strip(F.regexp_replace("title", QUALIFIER.replace("(?: and Defender XDR)?", ""), ""))
    own = F.coalesce(_filled(normalized_description(F.col("description"))), _filled(normalized_description(comment_description(F.col("body")))))
    described = titled.withColumn("description", F.coalesce(own, fallback_description(subject, F.col("tables"), _label(F.col("dialect")))))
    return described.withColumn("tags", derived_tags(F.col("dialect"), F.col("title"), F.col("description"), F.col("path"), F.col("body"), F.col("tables"), F.col("operators")))


# ---- names


def _first_free(frame: pd.DataFrame) -> pd.DataFrame:
    """Part numbers of one family of names: in order, each row takes the first that is free from its least one on."""
    after: dict[int, int] = {}

    def free(part: int) -> int:
        seen = []
        while part in after:
            seen.append(part)
            part = after[part]
        for x in seen:  # shortcuts, so that a long row of taken parts is passed once
            after[x] = part
        return part

    frame, parts = frame.sort_values(["path", "block", "_id"]), []
    for least in frame["_least"].tolist():
        part = free(least)
        after[part] = part + 1
        parts.append(part)
    return pd.DataFrame({"_id": frame["_id"], "_part": parts})


def unique_titles(rows: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``rows`` with titles that are unique in their repository, whatever the case. rows: repository, path, block, title, body, tables.

    In order of path and block each row takes the first free name of: its title, then title, detail and part number from
    block + 1 on. That order is settled in parallel, by deferred acceptance: all rows propose, a name keeps
    its first row in order, and the others go on to their next name, even if they held theirs for some rounds. As all names prefer the same order, what is
    stable is what a walk in order gives. Rows of one family (title and detail alike, some numbers each; an import is limited
    to 10,000 files) number their parts together, so rounds are few: they settle names that different families share. A round is
    written to the shared folder, and the one before is deleted. Rows that repeat repository, path and block stand in any order.
    """
    spark = rows.sparkSession
    detail = F.coalesce(comment_title(F.col("body")), _filled(intent_title(F.col("body"), F.col("tables"))))
    tail, base = F.regexp_extract("title", f"({QUALIFIER})", 1), F.regexp_replace(F.regexp_replace("title", QUALIFIER, ""), "(?i)\\s+-\\s+Part\\s+\\d+\\z", "")
    head = F.when(detail.isNotNull() & (F.lower(clean_text(detail)) != F.lower(clean_text(base))), F.concat(base, F.lit(": "), detail)).otherwise(base)
    ending = F.concat(F.lit(" - Part "), F.col("_part").cast("string"), F.col("_tail"))
    name = F.when(F.col("_part").isNull(), F.col("title")).otherwise(F.concat(F.rtrim(F.substring(F.col("_head"), F.lit(1), F.greatest(F.lit(1), MOST_TITLE - F.length(ending)))), ending))

    def stored(df: DataFrame) -> tuple[DataFrame, str]:
        path = new_folder(spark)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    now, path = stored(rows.select("*", head.alias("_head"), tail.alias("_tail"), F.lit(None).cast("long").alias("_least"), F.monotonically_increasing_id().alias("_id")))
    for _ in range(most_rounds):
        lost = now.where("_least is not null").select("repository", F.lower("_head").alias("_h"), F.lower("_tail").alias("_t"), "path", F.col("block").cast("long").alias("block"), "_id", "_least")
        parts = lost.groupBy("repository", "_h", "_t").applyInPandas(_first_free, "_id long, _part long")
        by = Window.partitionBy("repository", F.lower("_name")).orderBy("path", "block", "_id")
        placed = now.join(parts, "_id", "left").withColumn("_name", name).withColumn("_moved", F.row_number().over(by) > 1)
        least = F.when(~F.col("_moved"), F.col("_part")).otherwise(F.coalesce(F.col("_part"), F.col("block")) + 1)
        moved, next_path = stored(placed.select(*rows.columns, "_head", "_tail", least.cast("long").alias("_least"), "_id", "_name", "_moved"))
        remove(spark, path)
        path = next_path
        if moved.where("_moved").isEmpty():
            return moved.withColumn("title", F.col("_name")).select(*rows.columns)
        now = moved.drop("_name", "_moved")
    raise RuntimeError("names did not settle; raise most_rounds")
