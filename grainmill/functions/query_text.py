"""Rules on query texts as column expressions: shape, structure, what is no query, tables, operators, policy."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainmill.functions import text as t
from grainmill.functions.lexer import bound, dense_masked, dense_masks, location, masked

#: Longest query text; a fixed value.
MAX_BODY = 100_000

_NAME = "[A-Za-z_][A-Za-z0-9_]*"
#: Boundaries of ASCII words, whatever the engine takes ``\\b`` for.
_B = "(?<![A-Za-z0-9_])"
_E = "(?![A-Za-z0-9_])"
_BLANKS = " \t\n\x0b\x0c\r\u00a0\ufeff"


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(_BLANKS))


def _has(value: Column, pattern: str) -> Column:
    return F.rlike(value, F.lit(pattern))


# ---- shape; words and forms are fixed values

_STARTS = "alias|declare|evaluate|externaldata|find|let|macro-expand|print|range|restrict|search|set|union"
_SHAPE = f"(?i)\\A(?:(?:{_STARTS}){_E}|\\.[a-z-]+{_E}|(?:\\[\"[^\"\\r\\n]+\"\\]|{_NAME})(?:\\s*\\([^;\\r\\n]*\\))?\\s*(?:\\.|\\||;|\\z))"
_STAGES = (
    "as|consume|count|distinct|evaluate|extend|find|fork|getschema|invoke|join|lookup|make-series|mv-apply|mv-expand|order|parse|parse-kv|parse-where|partition|project|"
    "project-away|project-keep|project-rename|project-reorder|reduce|render|sample|sample-distinct|scan|search|serialize|sort|summarize|take|top|top-hitters|top-nested|union|where"
)
_LOOKS = f"(?i)\\|\\s*(?:{_STAGES}){_E}|\\A\\s*(?:let|declare|evaluate|externaldata|find|macro-expand|print|range|search|set|union){_E}"
_COMMAND = (
    "(?i)\\A(?:set\\s+\"[^\"\\r\\n]+=[^\"\\r\\n]*\"\\s*&&\\s*(?:cmd(?:\\.exe)?(?![a-z0-9_])|[a-z0-9_.-]+\\.exe(?![a-z0-9_]))|cmd(?:\\.exe)?\\s+/c(?![a-z0-9_])|(?:powershell|pwsh)(?:\\.exe)?\\s+[-/])"
)
_SENTENCE = "(?md)(?:^|[;\\n])\\s*(?:[A-Za-z][A-Za-z0-9_-]*\\s+[A-Za-z]|(?i:between(?![a-z0-9_])))[^|;=\\n]*[.!?]\\s*(?=$|[;\\n])"


def _shaped(code: Column) -> Column:
    return _has(strip(code), _SHAPE)


def _prose(blank: Column) -> Column:
    # a sentence ends in a sign that most code has not; blanks are taken possessively, so that a row of blank lines is passed once
    return _has(blank, "[.!?]") & _has(blank, _SENTENCE.replace("[;\\n])\\s*(?:", "[;\\n])\\s*+(?:"))


def has_source_shape(value: Column) -> Column:
    """Whether a text begins as a query does, comments aside: a statement's word, a command, or a name that a pipe, dot or end follows."""
    return _shaped(dense_masked(value, None))


def looks_like_query(value: Column) -> Column:
    """Whether a text has a query's shape and a stage or a leading statement besides."""
    return bound(strip(dense_masked(value, None)), lambda code: _has(code, _SHAPE) & _has(code, _LOOKS))


def is_shell(value: Column) -> Column:
    return _has(strip(dense_masked(value, None)), _COMMAND)


def is_prose(value: Column) -> Column:
    """Whether a statement or line reads like a sentence."""
    return _prose(dense_masked(value))


# ---- structure


def _walked(masked_body: Column) -> Column:
    """One pass over brackets and semicolons: the open brackets, whether one closed what was not open, the last statement's beginning.

    A closing bracket takes its opening one off the stack, at any depth; a semicolon outside of brackets ends a statement. The stack's top
    is a short string, and what lies deeper is in blocks, so a step costs the same at every depth.
    """
    state = F.struct(F.lit("").alias("top"), F.array().cast("array<string>").alias("deep"), F.lit(False).alias("bad"), F.lit("").alias("last"), F.lit("").alias("now"))

    def step(s: Column, c: Column) -> Column:
        opening, closing = c.isin("(", "[", "{"), c.isin(")", "]", "}")
        fits = closing & (F.right(s["top"], F.lit(1)) == F.translate(c, ")]}", "([{"))
        ends = (c == ";") & (s["top"] == "")
        full, drained = opening & (F.length(s["top"]) >= 64), fits & (F.length(s["top"]) == 1) & (F.size(s["deep"]) > 0)
        return F.struct(
            F.when(full, c).when(opening, F.concat(s["top"], c)).when(drained, F.get(s["deep"], F.lit(0))).when(fits, F.left(s["top"], F.length(s["top"]) - 1)).otherwise(s["top"]).alias("top"),
            F.when(full, F.concat(F.array(s["top"]), s["deep"])).when(drained, F.slice(s["deep"], F.lit(2), F.size(s["deep"]))).otherwise(s["deep"]).alias("deep"),
            (s["bad"] | (closing & ~fits)).alias("bad"),
            F.when(ends & (s["now"] != ""), s["now"]).otherwise(s["last"]).alias("last"),
            F.when(ends, "").when(F.length(s["now"]) < 64, F.ltrim(F.concat(s["now"], F.left(c, F.lit(64))))).otherwise(s["now"]).alias("now"),
        )

    parts = F.regexp_extract_all(F.regexp_replace(masked_body, "\\s+", " "), F.lit("[()\\[\\]{};]|[^()\\[\\]{};]++"), F.lit(0))
    last = lambda s: F.rtrim(F.when(F.trim(s["now"]) != "", s["now"]).otherwise(s["last"]))
    return F.aggregate(parts, state, step, lambda s: F.struct(s["top"].alias("open"), s["bad"].alias("bad"), last(s).alias("last")))


def structural_problem(body: Column) -> Column:
    """Why a text cannot be a query, or null.

    empty, too-long, code-fence, unbalanced-quote (strings and block comments), unbalanced-delimiter, empty-let, commented-wrapper,
    no-result, ends-with-declaration, leading-pipe, placeholder (the last statement is three dots).
    """
    return bound(dense_masks(body), lambda m: _problem(body, m))


def _problem(body: Column, m: Column) -> Column:
    empty_let = f"(?i){_B}let\\s+{_NAME}\\s*=\\s*(?:;|\\z)"
    of_walk = lambda w: (
        F.when((w["open"] != "") | w["bad"], "unbalanced-delimiter").when(_has(m["code"], empty_let), "empty-let")
        .when(_has(body, "(?mi)^\\s*//+\\s*let\\s+Function\\s*="), "commented-wrapper").when(w["last"] == "", "no-result")
        .when(_has(w["last"], f"(?i)^(?:alias|declare|let|pattern|restrict|set){_E}"), "ends-with-declaration")
        .when(w["last"].startswith("|"), "leading-pipe").when(w["last"] == "...", "placeholder")
    )
    # strings are quotes in the walked mask, so that a statement of one string is a statement
    return (
        F.when(strip(body) == "", "empty").when(F.length(body) > MAX_BODY, "too-long").when(_has(body, "\\A```|```\\z"), "code-fence")
        .when(~m["closed"], "unbalanced-quote").otherwise(bound(_walked(m["quoted"]), of_walk))
    )


def valid_query(value: Column) -> Column:
    """The text in normal form if it is a query, else null. The masks are made once, and what most texts that are none fail at is asked first."""
    control = "[\\x00\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"
    shaped = lambda n, m: _shaped(m["code"]) & ~_has(n, control) & ~_has(strip(m["code"]), _COMMAND) & ~_prose(m["blank"])
    fine = lambda n: (n != "") & (F.length(n) <= MAX_BODY) & bound(dense_masks(n), lambda m: shaped(n, m) & _problem(n, m).isNull())
    return bound(t.normalize_body(value), lambda n: F.when(fine(n), n))


# ---- tables and operators; words are fixed values

#: Words that are no tables where a table may stand.
NO_TABLES = """alias consume declare datatable evaluate externaldata find hint isfuzzy kind let macro-expand materialize pattern print range restrict search set union
withsource""".split()
#: Entities with arguments that are tables.
ENTITIES = ["fileinfo", "windowsevent", "windowsregistry"]
RESOURCE_TABLES = """advisorresources authorizationresources chaosresources desktopvirtualizationresources extendedlocationresources guestconfigurationresources healthresources
kubernetesconfigurationresources maintenanceresources migrateresources networkresources patchassessmentresources patchinstallationresources policyresources recoveryservicesresources
resourcechanges resourcecontainerchanges resourcecontainers resources securityresources servicefabricresources servicehealthresources spotresources supportresources tagsresources""".split()

_CALL = f"(?:{_NAME}\\([^)\\n]*\\)\\.)+"
#: Where tables stand in a masked text, in the order in which they are listed; group 1 is the name. No looks around, so that SQL can use them too.
LET_TABLE = f"(?i)\\blet\\s+{_NAME}\\s*=\\s*({_NAME})\\s*(?:\\||;|\\n)"
LET_ENTITY = f"(?i)\\blet\\s+{_NAME}\\s*=\\s*({_NAME})\\s*\\("
STATEMENT = f"(?:^|[;{{(])\\s*({_NAME})\\s*(?:\\||\\z)"
CALLED = f"(?:^|[;{{(])\\s*{_CALL}({_NAME})\\s*(?:\\||\\z)"
ENTITY = f"(?:^|[;{{(])\\s*({_NAME})\\s*\\("
#: Group 2 is not empty where the name is a column or a function.
JOINED = f"(?i)\\|\\s*(?:join|lookup)\\b\\s*(?:(?:kind|hint\\.[a-z_-]+)\\s*=\\s*[^\\s(]+\\s*)*\\(?\\s*(?:{_CALL})?({_NAME})\\s*([=(]?)"
UNION = f"(?i)(?:^|[;|{{(=])\\s*union\\b(?:\\s+{_NAME}\\s*=\\s*[^,\\s|]+)*\\s+([^|;]+)"
FOUND = "(?i)\\b(?:find|search)\\s+in\\s*\\(([^)]+)\\)"
LET_NAME = f"(?i)\\blet\\s+({_NAME})\\s*="
#: In the text itself.
TABLE_CALL = f"(?i)\\btable\\s*\\(\\s*('{_NAME}'|\"{_NAME}\")\\s*\\)"
#: A local function (1) whose first parameter (2) is a string, and its body (3), in the text without comments.
HELPER = f"(?i)\\blet\\s+({_NAME})\\s*=\\s*\\(\\s*({_NAME})\\s*:\\s*string\\b[^)]*\\)\\s*\\{{((?s:.*?))\\}}\\s*;"
OPERATOR = "\\|\\s*([A-Za-z][A-Za-z0-9-]*(?:\\s+by)?)"


def _all(value: Column, pattern: str, group: int = 1) -> Column:
    # engines differ on \\b beyond ASCII
    pattern = re.sub(r"(?<=[a-z)])\\b", lambda _: _E, pattern.replace("(?i)\\b", f"(?i){_B}"))
    pattern = pattern.replace("[A-Za-z0-9_]", "\\w")  # the same set, one look at a table instead of three ranges
    return F.regexp_extract_all(value, F.lit(pattern), F.lit(group))


def helper_tables(code: Column) -> Column:
    """Tables that calls pass to local functions which read ``table(parameter)``: none of a function where one call's argument is no literal name."""
    whole = F.arrays_zip(_all(code, HELPER, 1).alias("name"), _all(code, HELPER, 2).alias("par"), _all(code, HELPER, 3).alias("body"))
    helpers = F.filter(whole, lambda h: F.rlike(h["body"], F.concat(F.lit(f"(?i){_B}table\\s*\\(\\s*"), h["par"], F.lit("\\s*\\)"))))

    def passed(h: Column) -> Column:
        calls = F.regexp_extract_all(code, F.concat(F.lit(f"(?i){_B}"), h["name"], F.lit("\\s*\\(\\s*([^,\\r\\n)]+)")), F.lit(1))
        literal = lambda c: _has(strip(c), f"\\A(?:'{_NAME}'|\"{_NAME}\")\\z")
        return F.when(F.forall(calls, literal), F.transform(calls, lambda c: F.regexp_replace(c, "[\\s'\"]", ""))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(helpers, passed))


def source_tables(body: Column) -> Column:
    """Distinct names that a query reads from, whatever the case, less names of lets and own words, 64 at most.

    Quoted names in brackets are strings and do not count, as in the metadata that this must equal.
    """

    def listed(m: Column, code: Column) -> Column:
        entities = lambda p: F.filter(_all(m, p), lambda x: F.lower(x).isin(ENTITIES))
        joined = F.transform(F.filter(F.arrays_zip(_all(m, JOINED, 1).alias("name"), _all(m, JOINED, 2).alias("tail")), lambda x: x["tail"] == ""), lambda x: x["name"])
        items = lambda p: F.flatten(F.transform(_all(m, p), lambda x: F.split(x, ",")))
        union = F.transform(F.filter(items(UNION), lambda x: ~_has(x, f"\\A[\\s(]*{_NAME}\\*?\\s*\\(")), lambda x: F.regexp_extract(x, f"\\A\\s*\\(*\\s*({_NAME}\\*?)", 1))
        found = F.transform(items(FOUND), lambda x: F.regexp_extract(x, f"\\A\\s*({_NAME}\\*?)", 1))
        literal = F.transform(_all(body, TABLE_CALL), lambda x: F.regexp_replace(x, "['\"]", ""))
        every = F.concat(literal, helper_tables(code), _all(m, LET_TABLE), entities(LET_ENTITY), _all(m, STATEMENT), _all(m, CALLED), entities(ENTITY), joined, union, found)
        lets = F.transform(_all(m, LET_NAME), F.lower)
        kept = F.filter(every, lambda x: (x != "") & ~F.lower(x).isin(NO_TABLES) & ~F.array_contains(lets, F.lower(x)))
        return F.slice(t.first_spelling(kept), 1, 64)

    return bound(F.struct(dense_masked(body).alias("m"), dense_masked(body, None).alias("code")), lambda b: listed(b["m"], b["code"]))


def pipe_operators(body: Column) -> Column:
    """Distinct operators after a pipe, in order, 64 at most; ``order by`` and ``sort by`` keep their by."""

    def named(x: Column) -> Column:
        first = F.lower(F.regexp_extract(x, "^([A-Za-z0-9-]+)", 1))
        return F.when(first.isin("order", "sort") & x.endswith("by") & _has(x, "\\sby\\z"), F.concat(first, F.lit(" by"))).otherwise(first)

    return F.slice(F.array_distinct(F.transform(_all(dense_masked(body), OPERATOR), named)), 1, 64)


def inferred_dialect(tables: Column, fallback: Column) -> Column:
    """The graph dialect where a table of its own is read, but for the device dialect."""
    graph = F.exists(tables, lambda x: F.lower(x).isin(RESOURCE_TABLES))
    return F.when((fallback != "intune-device-query") & graph, "azure-resource-graph").otherwise(fallback)


def default_tables(tables: Column, dialect: Column) -> Column:
    """The graph dialect reads Resources where no table is written."""
    return F.when((dialect == "azure-resource-graph") & (F.size(tables) == 0), F.array(F.lit("Resources"))).otherwise(tables)


def kept_tables(body: Column, tables: Column, proposed: Column, most: int = 20) -> Column:
    """Tables found, and of those proposed the ones that stand in the text as identifiers, whatever the case."""
    here = F.filter(proposed, lambda p: F.rlike(body, F.concat(F.lit(f"(?i){_B}"), F.regexp_replace(p, "([^A-Za-z0-9_])", "\\\\$1"), F.lit(_E))))
    return F.slice(t.first_spelling(F.concat(tables, here)), 1, most)


# ---- policy; codes and forms are fixed values

#: (code, pattern on the text from its first character that is no comment, what the length covers)
POLICY = [
    ("KQL_MARKDOWN_NOT_ALLOWED", "(?i)\\A(?:```(?:kql|kusto)?(?:\\s|\\z)|(?:#{1,6}|>|[-+*])\\s)", "line"),
    ("KQL_SQL_NOT_ALLOWED", (
        "(?i)\\A(?:(?:select|with)\\b(?s:.*)\\b(?:from|select)\\b|insert\\s+into\\b|update\\s+\\S+\\s+set\\b|delete\\s+from\\b|merge\\s+into\\b|truncate\\s+table\\b|"
        "(?:create|alter|drop)\\s+(?:database|table|view|index|schema|procedure)\\b)"), "word"),
    ("KQL_SHELL_NOT_ALLOWED", (
        "(?i)\\A(?:#!|\\$\\s+|(?:sudo\\s+)?(?:bash|sh|zsh|fish|pwsh|powershell|cmd|curl|wget|ssh|scp|git|kubectl|helm|docker|podman|terraform|ansible|python\\d*|node|npm|npx|yarn|pnpm|"
        "az|aws|gcloud|echo|cd|ls|rm|chmod|chown|export)\\b)"), "word"),
    ("KQL_JSON_NOT_ALLOWED", "\\A[{\\[]", "one"),
    ("KQL_HTML_NOT_ALLOWED", "(?i)\\A<(?:!doctype\\b|!--|/?[a-z][a-z0-9:-]*\\b)", "word"),
]
PLACEHOLDER = "(?i)\\$\\{[^}\\r\\n]+\\}|\\{\\{[^}\\r\\n]+\\}\\}|\\b(?:YOUR|REPLACE|INSERT)[_-]?(?:TABLE|COLUMN|VALUE|QUERY)\\b|\\b(?:TODO|FIXME|REPLACE_ME)\\b"
CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]"


def policy_failure(body: Column) -> Column:
    """The first rule that a text breaks before it is looked at as a query: (code, start, length, line, col), or null."""
    none = F.lit(None).cast("struct<code:string,start:int,length:int>")
    hit = lambda code, start, length: F.struct(F.lit(code).alias("code"), start.cast("int").alias("start"), length.cast("int").alias("length"))
    p = lambda x: x.replace("\\b(?:from", f"{_B}(?:from").replace("\\b(?:YOUR", f"{_B}(?:YOUR").replace("\\b(?:TODO", f"{_B}(?:TODO").replace("\\b", _E)
    place = lambda value, pattern: F.regexp_instr(value, F.lit(pattern)) - 1
    word = lambda c: F.length(F.regexp_extract(c, "\\A(\\S+)", 1))
    spans = {"line": lambda c: F.greatest(F.lit(1), F.length(F.regexp_extract(c, "\\A([^\\r\\n]*)", 1))), "word": word, "one": lambda c: F.lit(1)}

    def of(b: Column) -> Column:
        start, content = F.length(body) - F.length(b["content"]), b["content"]
        out = F.when(F.length(body) > MAX_BODY, hit("KQL_QUERY_TOO_LARGE", F.lit(MAX_BODY), F.length(body) - MAX_BODY)).when(content == "", hit("KQL_EMPTY", F.lit(0), F.lit(0)))
        out = out.when(_has(body, CONTROL), hit("KQL_CONTROL_CHARACTER", place(body, CONTROL), F.lit(1)))
        for code, pattern, span in POLICY:
            out = out.when(_has(content, p(pattern)), hit(code, start, spans[span](content)))
        text = F.regexp_substr(b["m"], F.lit(p(PLACEHOLDER)))
        return out.when(text.isNotNull(), hit("KQL_PLACEHOLDER_NOT_ALLOWED", place(b["m"], p(PLACEHOLDER)), F.length(text))).otherwise(none)

    content = F.regexp_replace(body, "\\A(?:\\s++|//[^\\n]*+)*+", "")
    found = bound(F.struct(content.alias("content"), masked(body).alias("m")), of)
    return bound(found, lambda f: F.when(f.isNotNull(), F.struct(f["code"].alias("code"), f["start"].alias("start"), f["length"].alias("length"), location(body, f["start"])["line"].alias("line"), location(body, f["start"])["col"].alias("col"))))


# ---- scope


_SEARCHES = f"(?im)(?:^|[;|])\\s*(?:let\\s+{_NAME}\\s*=\\s*)?(?:search|find)\\b"
_IN_LIST = f"\\s+(?:(?:kind|withsource)\\s*=\\s*{_NAME}\\s+)*in\\s*\\("
_ALL_UNION = "(?im)\\bunion\\b(?:\\s+(?:kind|isfuzzy|withsource)\\s*=\\s*[^\\s,|]+)*\\s+\\*"
_CHOSEN = f"(?im)\\btable\\s*\\(\\s*{_NAME}\\s*\\)"


def scope_summary(body: Column, tables: Column, operators: Column) -> Column:
    """What a query reads, in words: its tables, else whether it searches all, or picks a table when it runs, or none.

    A search or find without a list of tables reads all; so does one that only ``operators``
    tells of, unless some search in the text has a list. Comments and strings say nothing.
    """

    def said(code: Column) -> Column:
        everywhere = _has(code, f"{_SEARCHES}(?!{_IN_LIST})") | (F.exists(operators, lambda x: F.lower(F.trim(x)).isin("find", "search")) & ~_has(code, f"(?im)\\b(?:search|find)\\b{_IN_LIST}"))
        return F.when(everywhere | _has(code, _ALL_UNION), "All tables in the current scope").when(_has(code, _CHOSEN), "Table name selected at runtime").otherwise("No physical table referenced")

    return F.when(F.size(tables) > 0, F.array_join(tables, ", ")).otherwise(bound(dense_masked(F.coalesce(body, F.lit(""))), said))
