"""Query texts made of the documents' own words and lines, the same in Spark and in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of join that the bodies use; the graph dialect lacks two of them.
KINDS = ["inner", "leftouter", "rightanti", "fullouter", "leftsemi"]

#: Parts of a body. Names in braces are the document's: whole (as comment lines), line (its first line), long (quotes doubled), a, b, c, d (words), kind, n (its length).
PARTS = [
    "// {whole}\nlet {a}Limit = {n}; /* {line} */\nlet {b}_ = {c} | where x == \"{long}\" and p == @\"C:\\\";\nunion isfuzzy=true {a}, {d}\n| where note has h'{b}' // {line}\n",
    "| join kind={kind} (\n    {c} | where v == ''\n) on Id\n| mv-expand v limit {n}\n",
    "| lookup {d} on $left.k\n| where t == '{line}'\n",
    "| summarize n = count() by bin(ts, 1h)\n| order by n desc",
]


def bodies(docs: DataFrame, key: str = "kql") -> DataFrame:
    """Adds body: all parts in order; the third, with a raw line in quotes, only where the text's length is even."""
    text = F.col(key)
    line = F.substring_index(text, "\n", 1)
    # the beginning with four words, taken without trying again: the rest of a text is not searched
    beginning = F.regexp_substr(text, F.lit("(?s)\\A(?>.*?\\p{Alpha}{4,}+){1,4}"))
    words = F.regexp_extract_all(beginning, F.lit("\\p{Alpha}{4,}"), F.lit(0))
    word = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit("Events"))
    values = {
        "whole": F.replace(text, F.lit("\n"), F.lit("\n// ")), "line": line, "long": F.replace(line, F.lit('"'), F.lit('""')), "a": word(0), "b": word(1), "c": word(2), "d": word(3),
        "kind": F.element_at(F.array(*map(F.lit, KINDS)), (F.length(text) % len(KINDS) + 1).cast("int")), "n": F.length(text).cast("string"),
    }

    def filled(part: str):
        return F.concat(*(values[p[1:-1]] if p.startswith("{") else F.lit(p) for p in _split(part)))

    body = F.concat(filled(PARTS[0]), filled(PARTS[1]), F.when(F.length(text) % 2 == 0, filled(PARTS[2])).otherwise(""), filled(PARTS[3]))
    return docs.withColumn("body", body)


def _split(part: str) -> list[str]:
    return [p for p in re.split(r"(\{[a-z]+\})", part) if p]


def _sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    word = lambda i: f"coalesce(w[{i + 1}], 'Events')"
    values = {
        "whole": "replace(kql, chr(10), chr(10) || '// ')", "line": "line", "long": "replace(line, '\"', '\"\"')", "a": word(0), "b": word(1), "c": word(2), "d": word(3),
        "kind": f"([{', '.join(map(quote, KINDS))}])[CAST(length(kql) % {len(KINDS)} AS INT) + 1]", "n": "CAST(length(kql) AS VARCHAR)",
    }
    parts = [" || ".join(values[p[1:-1]] if p.startswith("{") else quote(p) for p in _split(part)) for part in PARTS]
    return f"{parts[0]} || {parts[1]} || CASE WHEN length(kql) % 2 = 0 THEN {parts[2]} ELSE '' END || {parts[3]}"


#: The table q (query_id, dialect, kql, body), after the corpus.
SQL = f"q AS (SELECT query_id, dialect, kql, {_sql()} AS body FROM (SELECT *, split_part(kql, chr(10), 1) AS line, regexp_extract_all(kql, '[A-Za-z]{{4,}}') AS w FROM corpus))"
