"""Ingestion of repository files: gates, dialects, tags, sources, merge inputs. Blocks are in ``parsing``, rules on query texts in ``functions.query_text``.

Files are rows (repository, path, content). Everything is a column expression or a window;
a file that is refused keeps a row with a reason instead of vanishing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.functions import text as t

#: Limits of a repository import; fixed values.
MAX_ENTRIES, MAX_CANDIDATES, MAX_FILE_BYTES = 100_000, 10_000, 1_000_000


def license_reason(spdx: Column) -> Column:
    return (
        F.when(spdx.isin(t.APPROVED_LICENSES), "accepted").when(spdx.isNull() | (spdx == ""), "LICENSE_MISSING")
        .when(F.upper(spdx).isin("NOASSERTION", "OTHER"), "LICENSE_UNKNOWN").otherwise("LICENSE_NOT_ALLOWED")
    )


def header_license(content: Column) -> Column:
    """The SPDX id that one of the first 80 lines declares, or null."""
    lines = F.slice(F.split(content, "\\r?\\n"), 1, 80)
    found = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, "(?i)SPDX-License-Identifier:\\s*(.+)$", 1)), lambda x: x != "")
    return F.nullif(F.trim(F.regexp_replace(F.coalesce(F.get(found, F.lit(0)), F.lit("")), "\\s*(?:\\*/|-->)\\s*$", "")), F.lit(""))


def file_kind(path: Column) -> Column:
    """standalone, markdown, yaml or null, by extension."""
    ext = F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))
    return F.when(ext.isin("kql", "kusto"), "standalone").when(ext.isin("md", "markdown", "mdx"), "markdown").when(ext.isin("yaml", "yml"), "yaml")


def is_safe_path(path: Column) -> Column:
    parts = F.split(path, "/")
    return (path != "") & ~path.startswith("/") & ~F.contains(path, F.lit("\\")) & ~F.contains(path, F.char(F.lit(0))) & F.forall(parts, lambda x: ~x.isin("", ".", ".."))


def gated_files(files: DataFrame) -> DataFrame:
    """Adds kind and skip_reason (null: goes on). files: repository, spdx, path, content."""
    size = F.octet_length("content")
    declared = header_license(F.col("content"))
    gate = license_reason(F.col("spdx"))
    reason = (
        F.when(gate != "accepted", gate).when(~is_safe_path(F.col("path")), "UNSAFE_PATH").when(F.col("kind").isNull(), "UNSUPPORTED_FILE").when(size > MAX_FILE_BYTES, "FILE_TOO_LARGE")
        .when(F.trim("content") == "", "EMPTY_FILE").when(declared.isNotNull() & (declared != F.col("spdx")), "LICENSE_METADATA_MISMATCH")
    )
    return files.withColumn("kind", file_kind(F.col("path"))).withColumn("skip_reason", reason)


# ---- query text


def technique_tags(body: Column) -> Column:
    return F.transform(F.regexp_extract_all(body, F.lit(t.spark_pattern("\\bT\\d{4}(?:\\.\\d{3})?\\b")), F.lit(0)), F.lower)


def event_tags(body: Column) -> Column:
    found = F.regexp_extract_all(body, F.lit(t.spark_pattern("(?i)\\bEventId\\)?\\s*(?:==|=~|in)\\s*\\(?\\s*['\"]?(\\d{3,5})\\b")), F.lit(1))
    return F.transform(found, lambda x: F.concat(F.lit("event-id-"), x))


# ---- sources


def longest_prefix(paths: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Adds the dialect of each path's longest matching prefix rule; ``key`` tells the rows apart.

    A path's own prefixes, one for each folder, are joined with the rules by equality, whatever their number.
    """
    parts = F.split("path", "/")
    own = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    hits = paths.select(key, F.explode(own).alias("prefix")).join(rules, "prefix").groupBy(key).agg(F.max_by("dialect", F.struct(F.length("prefix"), "dialect")).alias("dialect"))
    return paths.join(hits, key, "left")


def url_parts(url: Column) -> dict[str, Column]:
    """Host, first path segment as branch and the decoded rest as path."""
    path = F.regexp_extract(url, "^[a-z]+://[^/?#]+/([^?#]*)", 1)
    return {
        "host": F.lower(F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1)),
        "branch": F.substring_index(path, "/", 1),
        "path": F.try_url_decode(F.regexp_replace(F.regexp_extract(path, "^[^/]*/(.*)$", 1), "\\+", "%2B")),
    }


def manifest_groups(rows: DataFrame) -> DataFrame:
    """One row a repository (whatever the case), with its number of distinct paths, branches and whether they agree."""
    return rows.groupBy(F.lower("repository").alias("repository")).agg(
        F.count_distinct("path").alias("paths"), F.min("path").alias("first_path"), F.count_distinct("branch").alias("branches")
    ).withColumn("consistent", F.col("branches") <= 1)


def read_manifest(spark, path: str, required: tuple[str, ...]) -> DataFrame:
    """A CSV manifest with quotes and line breaks in fields; a broken row or a missing column is an error."""
    rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "FAILFAST").csv(path)
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"the manifest lacks {', '.join(missing)}")
    return rows


def read_tree(spark, path: str) -> DataFrame:
    """All files below a folder as (path, content, size); content is null where it is not UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("content"), F.col("length").alias("size"))


def ordered_paths(files: DataFrame, collation: str = "en") -> DataFrame:
    """Distinct paths of each repository (path, repository, place), in the order of a language, whatever the case first; ties by code point."""
    by = Window.partitionBy("repository").orderBy(F.collate("path", collation), "path")
    return files.select("repository", "path").distinct().withColumn("place", F.row_number().over(by))


def skip_histogram(gated: DataFrame) -> DataFrame:
    return gated.groupBy(F.coalesce("skip_reason", F.lit("accepted")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def issue_samples(issues: DataFrame, most: int = 10) -> DataFrame:
    """Issues by code: their number and the first ids; partial heaps are merged, so no group is gathered."""
    rank = F.row_number().over(Window.partitionBy("code").orderBy("query_id"))
    salted = F.row_number().over(Window.partitionBy("code", F.pmod(F.xxhash64("query_id"), F.lit(64))).orderBy("query_id"))
    few = issues.withColumn("k", salted).where(F.col("k") <= most).withColumn("k", rank).where(F.col("k") <= most)
    samples = few.groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "query_id"))), lambda x: x["query_id"]), ",").alias("samples"))
    return issues.groupBy("code").agg(F.count(F.lit(1)).alias("n")).join(samples, "code")


def last_authors(commits: DataFrame) -> DataFrame:
    """Author of each path's latest commit."""
    return commits.groupBy("path").agg(F.max_by(F.coalesce("login", "name"), F.struct("ts", "sha")).alias("author"))


def root_notice(tree: DataFrame) -> DataFrame:
    """The first NOTICE file at each repository's root that is not too large."""
    hit = tree.where(F.rlike("path", F.lit("(?i)^NOTICE(?:\\.(?:txt|md))?$")) & (F.coalesce("size", F.lit(0)) <= MAX_FILE_BYTES))
    return hit.groupBy("repository").agg(F.min_by("path", "position").alias("path"))


def requested_paths(asked: DataFrame, tree: DataFrame) -> DataFrame:
    """Adds to each asked path what it is: unsafe, missing, unsupported or candidate."""
    there = tree.select("repository", "path", F.lit(True).alias("there")).distinct()
    state = F.when(~is_safe_path(F.col("path")), "unsafe").when(F.col("there").isNull(), "missing").when(file_kind(F.col("path")).isNull(), "unsupported").otherwise("candidate")
    return asked.join(there, ["repository", "path"], "left").withColumn("state", state).drop("there")


def checked_tree(tree: DataFrame, truncated: bool = False) -> DataFrame:
    """The tree, if it is whole and within the limits of an import."""
    if truncated:
        raise ValueError("the tree is not whole")
    sizes = tree.groupBy("repository").agg(F.count(F.lit(1)).alias("n"), F.sum(file_kind(F.col("path")).isNotNull().cast("int")).alias("candidates"))
    if not sizes.where((F.col("n") > MAX_ENTRIES) | (F.col("candidates") > MAX_CANDIDATES)).isEmpty():
        raise ValueError("a repository has too many entries")
    return tree


def is_repository_name(name: Column) -> Column:
    return F.rlike(name, F.lit("^[A-Za-z0-9](?:[A-Za-z0-9-]{0,38})/[A-Za-z0-9._-]{1,100}$")) & ~name.endswith("/.") & ~name.endswith("/..")


def is_safe_ref(ref: Column) -> Column:
    """A branch, tag or commit name that is no option, path trick or revision expression."""
    return F.rlike(ref, F.lit("^[A-Za-z0-9][A-Za-z0-9._/-]{0,254}$")) & ~F.contains(ref, F.lit("..")) & ~F.contains(ref, F.lit("//")) & ~ref.endswith("/") & ~ref.endswith(".lock")


def normalized_description(text: Column) -> Column:
    """Links and tags out, labels off, 900 characters at most, ending like a sentence; under 8 characters, nothing."""
    plain = F.regexp_replace(F.regexp_replace(text, "!\\[([^\\]]*)\\]\\([^)]+\\)", "$1"), "\\[([^\\]]+)\\]\\([^)]+\\)", "$1")
    plain = t.collapse(F.regexp_replace(F.regexp_replace(plain, "<[^>]+>", " "), "(?i)^(?:use\\s*case|purpose|description)\\s*:\\s*", ""))
    short = F.when(F.length(plain) > 900, F.concat(F.regexp_replace(F.substring(plain, 1, 897), "\\s+\\S*\\z", ""), F.lit("..."))).otherwise(plain)
    ended = F.when(F.rlike(short, F.lit("[.!?]\\z")), short).otherwise(F.concat(short, F.lit(".")))
    return F.when(F.length(plain) < 8, "").otherwise(ended)


#: Verbs of titles and of the descriptions made from them; fixed values.
VERBS = {
    "show": "Returns", "list": "Lists", "find": "Finds", "detect": "Detects", "identify": "Identifies", "monitor": "Monitors",
    "analy[sz]e": "Analyzes", "track": "Tracks", "check": "Checks", "count": "Counts", "get": "Returns",
}


def fallback_description(title: Column, tables: Column, label: Column) -> Column:
    """A sentence from the title's verb and the tables, where a query has no description."""
    low = lambda c: F.concat(F.lower(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))
    few = F.slice(tables, 1, 3)
    listed = F.when(F.size(few) == 2, F.array_join(few, " and ")).when(F.size(few) > 2, F.concat(F.array_join(F.slice(few, 1, 2), ", "), F.lit(", and "), F.get(few, F.lit(2)))).otherwise(F.get(few, F.lit(0)))
    source = F.when(F.size(tables) == 0, F.concat(F.lit(" in "), label)).when(F.size(tables) == 1, F.concat(F.lit(" from "), listed)).otherwise(F.concat(F.lit(" by correlating "), listed))
    made = [F.when(F.rlike(title, F.lit(f"(?i)^{v}\\s+.")), F.concat(F.lit(f"{verb} "), low(F.regexp_extract(title, f"(?i)^{v}\\s+(.+)", 1)), source)) for v, verb in VERBS.items()]
    plain = (
        F.when(F.size(tables) > 1, F.concat(F.lit("Correlates "), listed, F.lit(" to investigate "), low(title)))
        .when(F.size(tables) == 1, F.concat(F.lit("Queries "), listed, F.lit(" to investigate "), low(title))).otherwise(F.concat(F.lit("Runs "), low(title), F.lit(" in "), label))
    )
    text = F.coalesce(*made, plain)
    return F.when(F.rlike(text, F.lit("[.!?]\\z")), text).otherwise(F.concat(text, F.lit(".")))


def decoded_file(content: Column) -> Column:
    """Text of a base64 file, whatever its line breaks; null where it is not UTF-8."""
    raw = F.unbase64(F.regexp_replace(content, "\\s+", "")).cast("string")
    return F.when(F.is_valid_utf8(raw), raw)


def is_commit_id(value: Column) -> Column:
    return F.rlike(value, F.lit("^[0-9a-f]{40,64}$"))


def is_https_url(value: Column) -> Column:
    return F.rlike(value, F.lit("^https://[^\\s/?#]+"))


def checked_entries(entries: DataFrame) -> DataFrame:
    """Tree entries with the reason why one is not as it should be, or null."""
    reason = (
        F.when(~F.coalesce(F.col("type").isin("blob", "tree", "commit"), F.lit(False)), "type").when(~F.coalesce(is_commit_id(F.col("sha")), F.lit(False)), "sha")
        .when(~F.coalesce(is_https_url(F.col("url")), F.lit(False)), "url")
    )
    return entries.withColumn("reason", reason)


def missing_tables(spark, required: list[str]) -> list[str]:
    """Tables that the catalogue lacks; an import starts only where it lacks none."""
    return [t for t in required if not spark.catalog.tableExists(t)]


def licensed(repositories: DataFrame, licenses: DataFrame) -> DataFrame:
    """Repositories whose licence is recorded and allowed."""
    return repositories.join(licenses.where("allowed").select("spdx"), "spdx", "left_semi")


def import_totals(gated: DataFrame, existing: DataFrame) -> DataFrame:
    """Per repository: accepted files, and of these how many are new and how many are known; and those skipped."""
    known = existing.select("query_id", F.lit(True).alias("known")).distinct()
    rows = gated.join(known, "query_id", "left")
    fine = F.col("skip_reason").isNull()
    count = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(name)
    return rows.groupBy("repository").agg(count(fine, "accepted"), count(fine & F.col("known").isNull(), "inserted"), count(fine & F.col("known").isNotNull(), "unchanged"), count(~fine, "skipped"))
