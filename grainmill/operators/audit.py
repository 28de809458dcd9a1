"""Quality checks of the corpus, and of an index against its base."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.functions import text as t
from grainmill.functions.lexer import bound, masked
from grainmill.functions.query_text import is_prose, structural_problem

#: Lines that wrap a query in prose or shell; fixed value.
WRAPPER = r"""(?i)^\s*(?:use\s+case\s*:|what\s+it\s+does\s*:|purpose\s*:|description\s*:|author\s*:|query\s*:|intune\s+device\s+query\s*[-:]\s*kql\s*$|```(?:kql|kusto)?\s*$|#{1,6}\s+\S|set\s+"[^"\r\n]+=[^"\r\n]*"\s*&&\s*(?:cmd(?:\.exe)?\b|[A-Za-z0-9_.-]+\.exe\b)|cmd(?:\.exe)?\s+/c\b|powershell(?:\.exe)?\s+(?:-|/)|pwsh(?:\.exe)?\s+(?:-|/))"""
#: A typed column that only looks like a label; fixed value.
TYPED = r"(?i)^\s*(?:description|author)\s*:\s*(?:bool|datetime|decimal|dynamic|guid|int|long|real|string|timespan)(?:\s*[,)]|$)"


def findings(rows: DataFrame) -> DataFrame:
    """Rows (query_id, code). rows: documents with version_known; an unknown version ends a row's checks, but for tables and lists of their own."""
    line = lambda x: F.rlike(x, F.lit(WRAPPER)) & ~F.rlike(x, F.lit(TYPED))
    # comments may say what they like; a line or a sentence in the code may not
    wrapped = bound(masked(F.col("kql"), None), lambda code: F.exists(F.split(code, "\\r?\\n"), line)) | is_prose(F.col("kql"))
    checks = {
        "dangling-version": ~F.col("version_known"),
        "empty-description": F.trim("description") == "",
        "empty-tags": F.size("tags") == 0,
        **({"empty-explanation": F.trim(F.coalesce("explanation", F.lit(""))) == ""} if "explanation" in rows.columns else {}),
        "tableless": F.size("tables") == 0,
        "generic-title": t.is_generic_title(F.col("title")),
        "prose-wrapper": wrapped,
        "invalid-structure": structural_problem(F.col("kql")).isNotNull(),
        "suspicious-table": F.exists("tables", lambda x: F.lower(x).isin(t.SUSPICIOUS_TABLES)),
    }
    codes = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items())))
    return rows.select("query_id", F.explode(codes).alias("code"))


def version_states(heads: DataFrame, versions: DataFrame) -> DataFrame:
    """Heads that are not deleted with the fields of their current version and version_state: missing, dangling, foreign (another query's) or valid; only valid ones have fields."""
    own = versions.withColumnsRenamed({"version_id": "current_version_id", "query_id": "_owner"}).withColumn("_there", F.lit(True))
    rows = heads.where(~F.col("deleted")).select("query_id", "current_version_id").join(own, "current_version_id", "left")
    state = (
        F.when(F.coalesce("current_version_id", F.lit("")) == "", "missing").when(F.col("_there").isNull(), "dangling")
        .when(~F.col("_owner").eqNullSafe(F.col("query_id")), "foreign").otherwise("valid")
    )
    fields = [c for c in versions.columns if c not in ("version_id", "query_id")]
    rows = rows.withColumn("version_state", state)
    return rows.select("query_id", "current_version_id", "version_state", *(F.when(F.col("version_state") == "valid", F.col(c)).alias(c) for c in fields))


def audited(heads: DataFrame, versions: DataFrame, provenance: DataFrame, repositories: DataFrame) -> DataFrame:
    """Rows (query_id, code, detail) of a whole audit.

    A head whose version is not its own has that one finding; others are checked by ``findings``,
    and for titles that their source has already: these need a title, a source and a path.
    detail is the version's state, or the first id of an equal title, else null.
    """
    rows = version_states(heads, versions)
    broken = rows.where("version_state <> 'valid'").select("query_id", F.lit("current-version").alias("code"), F.col("version_state").alias("detail"))
    fine = rows.where("version_state = 'valid'").withColumn("version_known", F.lit(True))
    told = findings(fine).withColumn("detail", F.lit(None).cast("string"))
    came = provenance.where("source_path <> ''").select("query_id", "source_repository_id").distinct().join(repositories.select("source_repository_id", "repository"), "source_repository_id")
    again = duplicate_titles(fine.select("query_id", "title").join(came, "query_id")).select("query_id", F.lit("duplicate-source-title").alias("code"), F.col("first_id").alias("detail"))
    return broken.unionByName(told).unionByName(again)


def duplicate_titles(rows: DataFrame) -> DataFrame:
    """All but the first row, by id, of a source's equal titles; with the first one's id. The first ids are combined before the shuffle, and joined back."""
    named = rows.where((F.trim("title") != "") & F.col("repository").isNotNull()).withColumns({"_source": F.lower("repository"), "_title": F.lower(F.trim("title"))})
    first = named.groupBy("_source", "_title").agg(F.min("query_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return named.join(first, ["_source", "_title"]).where("query_id <> first_id").drop("_source", "_title")


def reconciled(base: DataFrame, index: DataFrame) -> DataFrame:
    """Rows (query_id, code) where the index lacks a document, has one that is not there, has it twice or differs in a field."""
    fields = [c for c in base.columns if c != "query_id"]
    have = index.groupBy("query_id").agg(F.count(F.lit(1)).alias("rows_"), *(F.min(c).alias(f"{c}_i") for c in fields)).withColumn("in_index", F.lit(True))
    both = base.withColumn("in_base", F.lit(True)).join(have, "query_id", "full")
    differs = F.col("rows_") != 1
    for c in fields:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"{c}_i"))
    code = F.when(F.col("in_base").isNull(), "index-unexpected").when(F.col("in_index").isNull(), "index-missing").when(differs, "index-mismatch")
    return both.select("query_id", code.alias("code")).where("code is not null")
