"""Import manifests: rows that name a file by its address become a plan of repositories and their files.

A row has upstream_source_url, upstream_repository, repository_default_branch,
repository_license_spdx and ingestion_license_status (``REQUIRED``; ``ingest.read_manifest``
reads the CSV). A plan is two tables, not one row with a list a repository: the files of a
large repository are spread over tasks like all others, and repositories are counted by
partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.text import APPROVED_LICENSES

#: Columns of a manifest; fixed values.
REQUIRED = ("upstream_source_url", "upstream_repository", "repository_default_branch", "repository_license_spdx", "ingestion_license_status")

#: Why a row's address names no file of its repository, in the order in which it is asked.
PROBLEMS = ("unsupported-url", "encoding", "repository", "branch", "no-path")


def _segments(path: Column) -> Column:
    """The decoded parts of a path, empty ones left out; a part that cannot be decoded is null. A plus sign is a plus sign."""
    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.try_url_decode(F.regexp_replace(x, "\\+", "%2B")))


def source_path(url: Column, repository: Column, branch: Column, host: str = "github.com") -> Column:
    """A struct (path, problem): the file that an address of the form https://host/owner/name/blob/branch/path names.

    Owner and name equal the repository's whatever the case, a branch may have several parts,
    and each part of the address is decoded by itself, so that an encoded slash does not make
    two parts of one. problem is one of PROBLEMS or null; path is null where there is one.
    """
    literal = host.replace(".", "\\.")
    place = F.regexp_extract(F.coalesce(url, F.lit("")), f"(?i)^https://{literal}(?::443)?(/[^?#]*)?", 1)
    known = F.coalesce(F.rlike(url, F.lit(f"(?i)^https://{literal}(?::443)?(?:[/?#]|$)")), F.lit(False))
    # each of these is used several times below: bound once, so that an address is cut and decoded once
    bound = F.array(F.struct(_segments(place).alias("all"), F.split(F.lower(repository), "/").alias("own"), F.split(branch, "/").alias("branch")))

    def judged(b: Column) -> Column:
        parts, own, wanted = b["all"], b["own"], b["branch"]
        rest = F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0)))
        path = F.array_join(F.slice(rest, F.size(wanted) + 1, F.greatest(F.size(rest) - F.size(wanted), F.lit(0))), "/")
        at = lambda n: F.get(parts, F.lit(n))
        mine = (at(2) == "blob") & (F.lower(at(0)) == F.get(own, F.lit(0))) & (F.lower(at(1)) == F.get(own, F.lit(1)))
        problem = (
            F.when(~known, PROBLEMS[0]).when(F.exists(parts, lambda x: x.isNull()), PROBLEMS[1]).when(~F.coalesce(mine, F.lit(False)), PROBLEMS[2])
            .when(~F.coalesce(F.slice(rest, F.lit(1), F.size(wanted)) == wanted, F.lit(False)), PROBLEMS[3]).when(path == "", PROBLEMS[4])
        )
        return F.struct(F.when(problem.isNull(), path).alias("path"), problem.alias("problem"))

    return F.get(F.transform(bound, judged), F.lit(0))


def eligible(rows: DataFrame, status: str) -> DataFrame:
    """Rows whose status allows an import; of these alone addresses and licences matter."""
    return rows.where(F.col("ingestion_license_status") == status)


def sources(rows: DataFrame, host: str = "github.com") -> DataFrame:
    """(key, repository, default_branch, license_spdx, path, problem) for each row; key is the repository in lower case."""
    found = source_path(F.col("upstream_source_url"), F.col("upstream_repository"), F.col("repository_default_branch"), host)
    return rows.select(
        F.lower("upstream_repository").alias("key"), F.col("upstream_repository").alias("repository"), F.col("repository_default_branch").alias("default_branch"),
        F.col("repository_license_spdx").alias("license_spdx"), F.inline(F.array(found)),
    )


def repositories(parsed: DataFrame, approved: list[str] = APPROVED_LICENSES) -> DataFrame:
    """One row a repository, whatever the case of its name, in the order of names.

    repository is its first spelling by code point, paths the number of its distinct files.
    problem is ``incomplete`` where a row lacks branch or licence, ``inconsistent`` where rows disagree on them, ``license`` where
    the licence is not among the approved ones, else null.
    """
    # files are made distinct first, so that a repository's count is a sum of partial counts; null paths are rows of a problem
    files = parsed.groupBy("key", "path").agg(*_ends("repository", "default_branch", "license_spdx"))
    merged = files.groupBy("key").agg(
        F.min("repository_low").alias("repository"), *(f(f"{c}_{e}").alias(f"{c}_{e}") for c in ("default_branch", "license_spdx") for e, f in (("low", F.min), ("high", F.max))),
        F.max("gaps").alias("gaps"), F.count("path").alias("paths"),
    )
    differs = lambda c: ~F.col(f"{c}_low").eqNullSafe(F.col(f"{c}_high"))
    problem = (
        F.when(F.col("gaps"), "incomplete").when(differs("default_branch") | differs("license_spdx"), "inconsistent")
        .when(~F.coalesce(F.col("license_spdx_low").isin(approved), F.lit(False)), "license")
    )
    return merged.select("key", "repository", F.col("default_branch_low").alias("default_branch"), F.col("license_spdx_low").alias("license_spdx"), "paths", problem.alias("problem")).orderBy("key")


def _ends(*columns: str) -> list[Column]:
    """Least and greatest value of each column; gaps: whether a branch or a licence is null."""
    out = [f(c).alias(f"{c}_{e}") for c in columns for e, f in (("low", F.min), ("high", F.max))]
    return [*out, F.max(F.col("default_branch").isNull() | F.col("license_spdx").isNull()).alias("gaps")]


def planned(rows: DataFrame, status: str, host: str = "github.com") -> tuple[DataFrame, DataFrame]:
    """The plan of an import: repositories, and distinct (key, path) of their files. Any problem is an error, and nothing is imported then."""
    parsed = sources(eligible(rows, status), host)
    broken = parsed.where("problem is not null").select("repository", "problem").limit(10).collect()
    if broken:
        raise ValueError("addresses do not name files of their repositories: " + ", ".join(f"{r['repository']} ({r['problem']})" for r in broken))
    found = repositories(parsed)
    broken = found.where("problem is not null").select("repository", "problem").limit(10).collect()
    if broken:
        raise ValueError("repositories cannot be imported: " + ", ".join(f"{r['repository']} ({r['problem']})" for r in broken))
    return found, parsed.select("key", "path").distinct()
