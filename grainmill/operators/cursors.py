"""Page cursors: the keys of a page's last row, percent-encoded."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(*parts: Column) -> Column:
    """Parts joined by a bar and encoded like a URI component."""
    text = F.replace(F.url_encode(F.concat_ws("|", *(p.cast("string") for p in parts))), F.lit("+"), F.lit("%20"))
    for mark in "!'()":
        text = F.replace(text, F.lit(f"%{ord(mark):02X}"), F.lit(mark))
    return text


def decode_list(cursor: str) -> tuple[str, str]:
    """(timestamp, id); the id follows the last bar."""
    stamp, bar, key = unquote(cursor).rpartition("|")
    if not bar or not stamp or not key:
        raise ValueError("the cursor is not valid")
    return stamp, key


def decode_ranked(cursor: str) -> tuple[int, str, str]:
    """(stars, timestamp, id)."""
    parts = unquote(cursor).split("|")
    if len(parts) != 3 or not parts[0].isdigit() or not parts[1] or not parts[2]:
        raise ValueError("the cursor is not valid")
    return int(parts[0]), parts[1], parts[2]
