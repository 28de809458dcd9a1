"""Tokens and masks of query texts.

One set of literal forms serves all: line and block comments, strings with escapes or doubled quotes, verbatim
strings (``@"C:\\"``), multi-line strings of three back-ticks or tildes. Masks are column expressions and keep every offset. Tokens
with offsets, lines and columns come from a scanner over Arrow batches, which needs no shuffle and keeps no state between rows.

Patterns loop possessively, so that a text without a closing quote costs one pass. Offsets count characters from 0, lines and columns from 1.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_COMMENT = r"//[^\n]*+"
BLOCK_COMMENT = r"/\*(?s:.*?)(?:\*/|\z)"
_ROWS = r"```(?s:.*?)(?:```|\z)|~~~(?s:.*?)(?:~~~|\z)"
_VERBATIM = "|".join(rf"@{q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+(?:{q}|\z)" for q in "\"'")
_PLAIN = "|".join(rf"{q}[^{q}\\]*+(?:(?:\\(?s:.)?+|{q}{q})[^{q}\\]*+)*+(?:{q}|\z)" for q in "\"'")
#: A text is a row of these: comments, strings, code without signs that could begin one, single such signs.
CHUNK = rf"{LINE_COMMENT}|{BLOCK_COMMENT}|{_ROWS}|{_VERBATIM}|{_PLAIN}|[^\"'/@`~]++|(?s:.)"
_CLOSED = "|".join(x.replace(r"|\z)", ")") for x in (BLOCK_COMMENT, _ROWS, _VERBATIM, _PLAIN))
#: The whole text, if all its strings and block comments end.
CLOSED = rf"\A(?:{LINE_COMMENT}|{_CLOSED}|[^\"'/@`~]++|/(?![/*])|@(?![\"'])|`(?!``)|~(?!~~))*+\z"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` looks at it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _joined(chunks: Column, strings: str | None) -> Column:
    by = lambda c, sign: F.regexp_replace(c, "[^\\n\\r]", sign)

    def chunk(c: Column) -> Column:
        out = F.when(c.startswith("//") | c.startswith("/*"), by(c, " "))
        if strings is not None:
            literal = c.startswith('"') | c.startswith("'") | c.startswith('@"') | c.startswith("@'") | c.startswith("```") | c.startswith("~~~")
            out = out.when(literal, by(c, strings))
        return out.otherwise(c)

    return F.array_join(F.transform(chunks, chunk), "")


def masked(body: Column, strings: str | None = " ") -> Column:
    """The text with blanks for its comments and ``strings`` for each character of its strings (None: strings stay); line breaks stay."""
    return _joined(F.regexp_extract_all(body, F.lit(CHUNK), F.lit(0)), strings)


def masks(body: Column) -> Column:
    """The masks that rules need, from one pass over the text: code (strings stay), blank and quoted (blanks or quotes for strings)."""
    every = lambda c: F.struct(_joined(c, None).alias("code"), _joined(c, " ").alias("blank"), _joined(c, '"').alias("quoted"))
    return bound(F.regexp_extract_all(body, F.lit(CHUNK), F.lit(0)), every)


def _dense(chunks: Column, strings: str | None) -> Column:
    """Like ``_joined`` without its offsets: one sign for each stretch of a line that is masked, one line break for blank lines in a row."""
    by = lambda c, sign: F.regexp_replace(c, "[^\\n\\r]++", sign)

    def chunk(c: Column) -> Column:
        out = F.when(c.startswith("//") & ~F.contains(c, F.lit("\r")), F.lit(" ")).when(c.startswith("//") | c.startswith("/*"), by(c, " "))
        if strings is not None:
            literal = c.startswith('"') | c.startswith("'") | c.startswith('@"') | c.startswith("@'") | c.startswith("```") | c.startswith("~~~")
            out = out.when(literal, by(c, strings))
        return out.otherwise(c)

    return F.regexp_replace(F.array_join(F.transform(chunks, chunk), ""), "\\n(?:[ \\t]*+\\n)++", "\n")


def dense_masked(body: Column, strings: str | None = " ") -> Column:
    """``masked`` for rules that ask what stands where in order, not at which offset: what is masked is short, so rules pass over it at once."""
    return _dense(F.regexp_extract_all(body, F.lit(CHUNK), F.lit(0)), strings)


def dense_masks(body: Column) -> Column:
    """The dense masks that rules need, from one pass over the text: code (strings stay), blank and quoted (a blank or quote for strings); and closed.

    Only the last chunk can be one that does not end, so that is all that ``closed`` looks at.
    """
    closed = lambda c: F.coalesce(all_closed(F.element_at(F.concat(F.array(F.lit("")), c), -1)), F.lit(True))
    every = lambda c: F.struct(_dense(c, None).alias("code"), _dense(c, " ").alias("blank"), _dense(c, '"').alias("quoted"), closed(c).alias("closed"))
    return bound(F.regexp_extract_all(body, F.lit(CHUNK), F.lit(0)), every)


def all_closed(body: Column) -> Column:
    """Whether all strings and block comments end."""
    return F.rlike(body, F.lit(CLOSED))


# ---- tokens; the words of each class are fixed values

KEYWORDS = """alias as asc by consume count datatable declare desc distinct evaluate extend externaldata facet find fork from getschema invoke join kind let limit lookup
materialize nulls of on order parse partition print project range reduce render restrict sample scan search serialize set sort step summarize take to top union view where with""".split()
HYPHENATED = "make-series mv-apply mv-expand parse-kv parse-where project-away project-keep project-rename project-reorder sample-distinct top-hitters top-nested".split()
WORD_OPERATORS = """and between contains contains_cs endswith endswith_cs has has_all has_any has_cs hasprefix hasprefix_cs hassuffix hassuffix_cs in like matches not notbetween
notcontains notcontains_cs notendswith notendswith_cs notin notlike notstartswith notstartswith_cs or regex startswith startswith_cs""".split()
TYPES = "bool boolean date datetime decimal double dynamic guid int long real string time timespan typeof uniqueid uuid".split()
CONSTANTS = """anti broadcast false first fullouter inner innerunique last leftanti leftantisemi leftouter leftsemi null rightanti rightantisemi rightouter rightsemi
shuffle true""".split()
OPERATORS = "== != <= >= =~ !~ => := .. && || | + - * / % = < > ! ~ ?".split()
UNITS = "microseconds? milliseconds? nanoseconds? seconds? minutes? hours? days? ticks? ns us ms s m h d [lL]".split()

_WORD_END = "(?![A-Za-z0-9_])"


def _any(words: list[str]) -> str:
    return "|".join(map(re.escape, words))


#: Kinds and their patterns; the first that matches at a place counts. ``name`` and ``space`` have no class.
KINDS = {
    "comment": "//[^\\n]*+",
    "string": "```(?s:.*?)(?:```|\\Z)|" + "|".join(rf"[hH]?+@{q}[^{q}\r\n]*+(?:{q}{q}[^{q}\r\n]*+)*+{q}?+|[hH]?+{q}[^{q}\\\r\n]*+(?:\\(?s:.)?+[^{q}\\\r\n]*+)*+{q}?+" for q in "\"'"),
    "property": "|".join(rf"\[{q}(?:\\(?s:.)|{q}{q}|[^{q}\\\r\n])*+{q}\]" for q in "\"'"),
    "keyword": f"(?:{_any(sorted(HYPHENATED, key=len, reverse=True))}){_WORD_END}",
    "operator": f"(?:{_any(WORD_OPERATORS)}){_WORD_END}",
    "type": f"(?:{_any(TYPES)}){_WORD_END}",
    "constant": f"(?:{_any(CONSTANTS)}){_WORD_END}",
    "function": "[A-Za-z_][A-Za-z0-9_]*+(?=\\s*\\()",
    "keyword_": f"(?:{_any(KEYWORDS)}){_WORD_END}",
    "name": "[A-Za-z_][A-Za-z0-9_]*+",
    "variable": "\\$[A-Za-z_][A-Za-z0-9_]*+",
    "number": f"(?:0[xX][0-9a-fA-F]+|(?:[0-9]+\\.[0-9]+|[0-9]+|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)(?:{'|'.join(UNITS)})?",
    "operator_": _any(OPERATORS),
    "punctuation": "[()\\[\\]{},;.:]",
    "space": "\\s++|(?s:.)",
}
_SCANNER = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS.items()))


def scan(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, stop, kind) of all that is no space, in order."""
    for m in _SCANNER.finditer(text):
        if m.lastgroup != "space":
            yield m.start(), m.end(), m.lastgroup.rstrip("_")


def spans(text: str) -> list[list]:
    """Classified stretches that do not cross lines: [start, stop, kind]; neighbours of one kind that touch are one."""
    out: list[list] = []
    for start, stop, kind in scan(text):
        if kind == "name":
            continue
        while start < stop:
            cut = text.find("\n", start, stop)
            end = stop if cut < 0 else cut
            if end > start:
                if out and out[-1][2] == kind and out[-1][1] == start:
                    out[-1][1] = end
                else:
                    out.append([start, end, kind])
            start = end + 1 if cut >= 0 else stop
    return out


_TOKEN = "start int, stop int, line int, col int, kind string, token string"


#: Tokens that leave a worker at once.
BATCH = 20_000


def lexemes(rows: DataFrame, key: str, body: str, names: bool = False, also: Sequence[str] = ()) -> DataFrame:
    """Tokens of query texts: (key, start, stop, line, col, kind, token, and the columns ``also`` of the text's row).

    With ``names``, all tokens as they stand, words without a class as ``name``, for rules on sequences; else the
    classified stretches of a line. A null text has none. A worker holds one text and some 20,000 tokens, however many texts come at once.
    """
    kept = [key, *also]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, cols = [], [[] for _ in range(6)]

            def flushed() -> pa.RecordBatch:
                own = [b.column(j).take(pa.array(at, pa.int64())) for j in range(len(kept))]  # noqa: B023
                made = [*(pa.array(c, pa.int32()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])]  # noqa: B023
                return pa.record_batch([own[0], *made, *own[1:]], names=[key, "start", "stop", "line", "col", "kind", "token", *also])

            for i, value in enumerate(b.column(len(kept))):
                text = value.as_py()
                if text is None:
                    continue
                lines = [0, *(m.end() for m in re.finditer("\n", text))]
                for start, stop, what in scan(text) if names else spans(text):
                    line = bisect_right(lines, start)
                    for c, v in zip(cols, (start, stop, line, start - lines[line - 1] + 1, what, text[start:stop]), strict=True):
                        c.append(v)
                    at.append(i)
                    if len(at) >= BATCH:
                        yield flushed()
                        at, cols = [], [[] for _ in range(6)]
            yield flushed()

    typed = lambda c: f"`{c}` {rows.schema[c].dataType.simpleString()}"
    return rows.select(*kept, body).mapInArrow(run, ", ".join([typed(key), _TOKEN, *map(typed, also)]))


def location(body: Column, start: Column) -> Column:
    """Line and column of an offset, from 1."""
    before = F.left(body, start)
    return F.struct(F.size(F.split(before, "\n", -1)).alias("line"), (F.length(F.substring_index(before, "\n", -1)) + 1).alias("col"))
