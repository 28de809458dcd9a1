"""Registered queries over the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from grainmill.plans import corpus_queries, enrichment_queries, guard_queries, ingest_queries, lexer_queries, lifecycle_queries, parsing_queries, record_queries, review_queries, search_queries, service_queries, state_queries, text_queries  # noqa: F401
from grainmill.plans.catalogue import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)


def flagship(spark, sf_dir):
    return search_queries.lexical_search(spark, sf_dir)
