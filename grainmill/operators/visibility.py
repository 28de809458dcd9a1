"""Visibility and list filters, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def readable(viewer: int | None) -> Column:
    """Public rows, and the viewer's own; nothing that was deleted, and of others nothing that moderation took down."""
    return public() if viewer is None else ~F.col("deleted") & (public() | (F.col("owner_id") == viewer))


def public() -> Column:
    return (F.col("visibility") == "public") & (F.col("moderation_status") == "visible") & ~F.col("deleted")


def feed_rule(provider: str | Column = "provider") -> Column:
    """Public rows with a current version that have an owner or came from a repository: bundled samples stay out of the feed."""
    came = F.col(provider) if isinstance(provider, str) else provider
    return public() & F.col("version_id").isNotNull() & (F.col("owner_id").isNotNull() | F.coalesce(came == "github", F.lit(False)))


def any_of(column: str | Column, values: Sequence[str]) -> Column:
    """Equality with one of the values; no values, no restriction."""
    return (F.col(column) if isinstance(column, str) else column).isin(list(values)) if values else F.lit(True)


def array_has(column: str, values: Sequence[str]) -> Column:
    """One element of the array equals one of the values, whatever the case."""
    wanted = [v.lower() for v in values]
    return F.exists(column, lambda x: F.lower(x).isin(wanted)) if wanted else F.lit(True)


def search_filters(dialects=(), tables=(), operators=(), tags=(), authors=(), sources=()) -> Column:
    """Fields are joined by AND, the values of a field by OR."""
    return (
        any_of("dialect", dialects) & array_has("tables", tables) & array_has("operators", operators) & array_has("tags", tags)
        & any_of(F.lower("repository"), [a.lower() for a in authors]) & any_of(F.lower("repository"), [s.lower() for s in sources])
    )


def after(keys: Sequence[tuple[str, object]]) -> Column:
    """Keyset predicate for descending keys: rows that come after the cursor's values."""
    (name, value), *rest = keys
    here = F.col(name) < F.lit(value)
    return here | ((F.col(name) == F.lit(value)) & after(rest)) if rest else here


def clamp_limit(limit: int | None, default: int = 25, most: int = 100) -> int:
    """A page size; no whole number from 1 to ``most`` is refused."""
    if limit is None:
        return default
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= most:
        raise ValueError(f"limit must be a whole number from 1 to {most}")
    return limit
