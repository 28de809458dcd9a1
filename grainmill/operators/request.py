"""Search requests: limits, aliases and defaults, before any plan is made."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from grainmill.functions.text import DIALECT_ALIASES

#: Request limits; fixed values.
MAX_QUERY, MAX_FILTER, MAX_VALUES, MAX_CURSOR, DEFAULT_LIMIT, MAX_LIMIT = 2000, 120, 20, 512, 20, 50
FIELDS = {"dialects": "dialect", "tables": "table", "operators": "operator", "tags": "tag", "authors": "author", "sources": "source"}


class RequestError(ValueError):
    """A request that cannot be served; ``code`` says why."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


@dataclass
class Request:
    q: str
    filters: dict[str, list[str]] = field(default_factory=dict)
    cursor: str | None = None
    limit: int = DEFAULT_LIMIT


def squeeze(text: str) -> str:
    """NFKC, with runs of white space as one blank."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text)).strip()


def _values(raw: Sequence[str], name: str) -> list[str]:
    found: dict[str, str] = {}
    for part in (p for value in raw for p in value.split(",")):
        value = squeeze(part)
        if len(value) > MAX_FILTER:
            raise RequestError("filter_too_long", f"values of {name} have {MAX_FILTER} characters at most")
        if value:
            found.setdefault(value.lower(), value)
    if len(found) > MAX_VALUES:
        raise RequestError("too_many_filters", f"{name} takes {MAX_VALUES} values at most")
    if name == "dialects":
        if bad := [v for k, v in found.items() if k not in DIALECT_ALIASES]:
            raise RequestError("invalid_dialect", f"no dialect has the name {bad[0]}")
        return list(dict.fromkeys(DIALECT_ALIASES[k] for k in found))
    return list(found.values())


def _request(q: object, lists: Mapping[str, Sequence[str]], cursor: object, limit: object) -> Request:
    text = squeeze(q) if isinstance(q, str) else ""
    if not text:
        raise RequestError("query_required", "a search needs words")
    if len(text) > MAX_QUERY:
        raise RequestError("query_too_long", f"a search has {MAX_QUERY} characters at most")
    cursor = cursor if isinstance(cursor, str) and cursor else None
    if cursor and (len(cursor) > MAX_CURSOR or re.search(r"[\x00-\x1f\x7f]", cursor)):
        raise RequestError("invalid_cursor", "the cursor is not valid")
    n = DEFAULT_LIMIT if limit in (None, "") else limit
    if isinstance(n, bool) or not re.fullmatch(r"\d+", str(n)) or not 1 <= int(n) <= MAX_LIMIT:
        raise RequestError("invalid_limit", f"limit is a whole number from 1 to {MAX_LIMIT}")
    return Request(text, {k: _values(v, k) for k, v in lists.items()}, cursor, int(n))


def from_params(params: Mapping[str, Sequence[str]]) -> Request:
    """From URL parameters: singular and plural names, and lists with commas."""
    first = lambda k: next(iter(params.get(k, [])), None)
    lists = {many: [*params.get(one, []), *params.get(many, [])] for many, one in FIELDS.items()}
    return _request(first("q"), lists, first("cursor"), first("limit"))


def from_body(body: object) -> Request:
    """From a JSON object: plural names with arrays of strings only."""
    if not isinstance(body, dict):
        raise RequestError("invalid_body", "the body must be a JSON object")
    lists = {}
    for name in FIELDS:
        value = body.get(name) or []
        if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
            raise RequestError("invalid_filter", f"{name} must be an array of strings")
        lists[name] = value
    limit = body.get("limit")
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int)):
        raise RequestError("invalid_limit", "limit must be a whole number")
    return _request(body.get("q"), lists, body.get("cursor"), limit)


def dialect_required(request: Request, dialect: str | None, confidence: float) -> bool:
    """No dialect was asked for, and none was recognised with a confidence of 0.75."""
    return not request.filters.get("dialects") and (not dialect or confidence < 0.75)


def intent_text(request: Request, intent: Mapping[str, object] | None) -> str:
    """What is embedded: the request, or an intent's words in order."""
    if not intent:
        return request.q
    parts = [intent.get("query") or request.q, *(v for k in ("concepts", "tables", "operators", "tags") for v in intent.get(k, []))]
    return squeeze(" ".join(parts))
