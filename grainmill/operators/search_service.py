"""A search from its request to its outcome: stages one after the other, each of which may fail without taking the others with it.

Spark evaluates late, so a stage's failure would show at the reader of the results. Every stage
therefore writes its few rows (a page of hits, 50 candidates a namespace) when it is its turn:
one small job a stage, and none that is not needed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.operators import retrieval
from grainmill.operators.request import Request, dialect_required, intent_text
from grainmill.sources.scratch import written

KEYS = ["query_id", "version_id"]


class SearchUnavailable(RuntimeError):
    """The lexical stage failed: there is nothing to fall back to."""


@dataclass(frozen=True)
class Issue:
    stage: str
    code: str
    recoverable: bool = True


@dataclass(frozen=True)
class Fallback:
    """What a generated answer could start from: ``available`` only if retrieval was whole."""

    status: str
    reason: str
    dialect_required: bool


@dataclass(frozen=True)
class Outcome:
    """results: query_id, version_id, title, tables, match_type, score, star_count and place, a page at most."""

    results: DataFrame
    mode: str
    adequacy: dict
    intent: Mapping[str, object] | None
    attempted: tuple[str, ...]
    issues: tuple[Issue, ...]
    fallback: Fallback | None


@dataclass(frozen=True)
class Stages:
    """What a search asks of its surroundings.

    lexical: hits of a request with query_id, version_id, title, tables, score and star_count, of
    what the viewer may read. intent: what the request means (may be None: not asked). embed: a
    text's vector. semantic: (namespace, vector, limit) to candidates with query_id, version_id
    and score. authorised: candidates' query_id, 50 a namespace at most, to the current rows that
    the viewer may read and the request's filters let pass, with version_id, title, tables and star_count.
    """

    lexical: Callable[[Request], DataFrame]
    embed: Callable[[str], Sequence[float]]
    semantic: Callable[[str, Sequence[float], int], DataFrame]
    authorised: Callable[[DataFrame], DataFrame]
    intent: Callable[[Request], Mapping[str, object] | None] | None = None


def search(request: Request, viewer: int | None, stages: Stages) -> Outcome:
    """Lexical hits alone where they are adequate; else merged with what is near in meaning, as far as its stages work."""
    attempted, issues = ["lexical"], []
    try:
        hits = written(stages.lexical(request).select(*KEYS, "title", "tables", "score", "star_count"))
        hits = hits.withColumn("place", _place("star_count"))
        told = retrieval.adequacy(hits, request.q).first().asDict()
    except Exception as cause:
        raise SearchUnavailable("the search cannot be answered now") from cause
    page = hits.where(F.col("place") <= request.limit).withColumn("match_type", F.lit("lexical"))

    def outcome(results: DataFrame, adequacy: dict, intent, fallback: Fallback | None) -> Outcome:
        mode = retrieval.retrieval_mode(results).first()["mode"]
        return Outcome(results, mode, adequacy, intent, tuple(attempted), tuple(issues), fallback)

    if told["adequate"]:
        return outcome(page, told, None, None)

    attempted.append("intent")
    intent = None
    try:
        intent = stages.intent(request) if stages.intent else None
    except Exception:  # noqa: BLE001  a search goes on without it
        issues.append(Issue("intent", "intent_extraction_failed"))
    needs = dialect_required(request, (intent or {}).get("dialect"), (intent or {}).get("dialect_confidence", 0.0))

    attempted.append("embedding")
    try:
        vector = stages.embed(intent_text(request, intent))
    except Exception:  # noqa: BLE001
        issues.append(Issue("embedding", "embedding_failed"))
        return outcome(page, told, intent, Fallback("unavailable", "retrieval-incomplete", needs))

    attempted.append("semantic")
    found, whole = [], True
    for i, name in enumerate(retrieval.namespaces(viewer)):
        try:
            near = stages.semantic(name, vector, max(10, min(50, 2 * request.limit))).select(*KEYS, "score")
            found.append(written(near.withColumn("place", _place() + 100 * i)))  # a namespace has 50 at most, the first one's come first
        except Exception:  # noqa: BLE001  the other namespaces still count
            whole = False
    if not whole:
        issues.append(Issue("semantic", "semantic_search_failed"))

    results = page
    near = reduce(DataFrame.unionByName, found) if found else None
    if near is not None and not near.isEmpty():
        attempted.append("authorization")
        try:
            allowed = written(stages.authorised(near.select("query_id").distinct()).select(*KEYS, "title", "tables", "star_count"))
            results = _merged(hits, allowed, near, request.limit)
        except Exception:  # noqa: BLE001  nothing is shown that was not allowed
            issues.append(Issue("authorization", "authorization_check_failed", recoverable=False))
            whole = False
    told = retrieval.adequacy(results, request.q).first().asDict()
    if told["adequate"]:
        return outcome(results, told, intent, None)
    fallback = Fallback("available", "retrieval-inadequate", needs) if whole else Fallback("unavailable", "retrieval-incomplete", needs)
    return outcome(results, told, intent, fallback)


def _place(*then: str):
    """The place among the rows of one page or namespace, from 1."""
    return F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), *map(F.desc, then), "query_id"))


def _merged(hits: DataFrame, allowed: DataFrame, near: DataFrame, limit: int) -> DataFrame:
    """The merged page, with the titles and tables that its adequacy is judged by; all sides are a page or 100 rows."""
    merged = retrieval.hybrid(hits, allowed, near, limit)
    shown = ["title", "tables"]
    named = hits.select(*KEYS, *shown).unionByName(allowed.select(*KEYS, *shown)).dropDuplicates(KEYS)
    return written(merged.join(F.broadcast(named), KEYS).withColumn("place", _place("star_count")))
