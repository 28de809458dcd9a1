"""Text rules as column expressions, and the same rules for SQL from one list.

Patterns are written with the ASCII word boundary \\b of the rules' own definition; Spark's
engine counts letters beyond ASCII as word characters there, so it gets the boundary spelled out.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_BOUNDARY = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

#: Rules that name secrets in a text; fixed values.
SECRET_RULES = [
    ("github-token", r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{30,})\b"),
    ("json-web-token", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b"),
    ("storage-connection-string", r"(?i)\bDefaultEndpointsProtocol=https?;AccountName=[^;\s]+;AccountKey=[^;\s]+"),
    ("bearer-token", r"(?i)\bBearer\s+[A-Za-z0-9._~+/-]{20,}=*"),
    ("assigned-secret", r"""(?i)\b(?:api[_-]?key|client[_-]?secret|password|passwd|access[_-]?token)\b\s*(?:=|:|==)\s*["'][^"'\r\n]{8,}["']"""),
]

#: Rules that keep personal data and secrets out of tags; fixed values.
TAG_RULES = [
    ("control-or-markup", r"[\x00-\x1f\x7f<>]"),
    ("email", r"\b[^\s@]+@[^\s@]+\.[^\s@]+\b"),
    ("url", r"(?i)\b(?:https?://|www\.)"),
    ("ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("uuid", r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b"),
    ("token-like", r"(?i)\b(?:[A-Za-z0-9+/]{32,}={0,2}|[0-9a-f]{32,})\b"),
]

#: Topics of query texts; fixed values.
TOPIC_RULES = [
    ("application-hang", r"\bapplication\s+(?:hang|hung|freeze|freezing)\b"),
    ("application-crash", r"\bapplication\s+(?:crash|crashes|error|failure)\b"),
    ("password-spray", r"\bpassword\s+spray\b"),
    ("brute-force", r"\bbrute[\s-]?force\b"),
    ("lateral-movement", r"\blateral\s+movement\b"),
    ("privileged-access", r"\bprivilege(?:d)?\s+(?:escalation|role|access)\b"),
    ("conditional-access", r"\bconditional\s+access\b"),
    ("authentication", r"\b(?:sign[\s-]?in|logon|login|authentication)\b"),
    ("phishing", r"\bphish(?:ing)?\b"),
    ("ransomware", r"\bransomware\b"),
    ("malware", r"\bmalware\b"),
    ("powershell", r"\bpowershell\b"),
    ("dns", r"\b(?:dns|domain\s+name\s+system)\b"),
    ("network", r"\b(?:firewall|network|ip\s+address|connection)\b"),
    ("registry", r"\b(?:registry|run\s+key)\b"),
    ("certificate", r"\bcertificate\b"),
    ("vulnerability-management", r"\b(?:vulnerability|cve-\d{4}-\d+)\b"),
    ("threat-intelligence", r"\b(?:threat\s+intelligence|indicator\s+of\s+compromise|ioc)\b"),
    ("email-security", r"\b(?:email|mailbox|exchange|inbox)\b"),
    ("process", r"\b(?:process|command\s+line)\b"),
    ("file", r"\b(?:file|folder|directory)\b"),
    ("audit", r"\b(?:audit|auditing)\b"),
    ("incident", r"\b(?:incident|alert)\b"),
    ("configuration", r"\b(?:compliance|configuration)\b"),
    ("monitoring", r"\b(?:monitor|monitoring)\b"),
    ("troubleshooting", r"\b(?:troubleshoot|troubleshooting)\b"),
]

#: Table families and their tags; fixed values.
CATEGORY_RULES = [
    ("identity", r"\b(?:AAD|AuditLogs|SigninLogs|Entra|Identity)"),
    ("endpoint", r"\bDevice(?:Events|Info|File|Image|Logon|Network|Process|Registry|Tvm)"),
    ("email-security", r"\b(?:Email|UrlClick|OfficeActivity)"),
    ("event-log", r"\b(?:SecurityEvent|WindowsEvent|Syslog|CommonSecurityLog)\b"),
    ("threat-intelligence", r"\b(?:ThreatIntel|ThreatIntelligence)"),
    ("vulnerability-management", r"\bDeviceTvm"),
]

#: Words that are operators, not tables; fixed values.
SUSPICIOUS_TABLES = [
    "as", "evaluate", "extend", "find", "hint", "invoke", "join", "kind", "limit", "lookup", "on", "order",
    "parse", "project", "render", "search", "sort", "summarize", "take", "union", "where", "withsource",
]

#: Licenses that may be ingested; fixed values.
APPROVED_LICENSES = ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "ISC", "Unlicense", "CC0-1.0"]

#: Title parts that say nothing about a query; fixed value.
GENERIC_PART = (
    r"(?:(?:microsoft\s+)?sentinel|log\s+analytics|(?:microsoft\s+)?defender(?:\s+xdr|\s+365|\s+antivirus(?:\s+detections?)?|\s+for\s+(?:cloud|cloud\s+apps|endpoint|identity|office\s+365))?"
    r"|(?:microsoft\s+)?365\s+defender|(?:microsoft\s+|unified\s+)?xdr|advanced\s+hunting|azure\s+data\s+explorer|(?:azure\s+)?resource\s+graph|resources?|adx|fabric|intune\s+device\s+query"
    r"|kql|kusto|query|queries|query\s+information|description|purpose|use\s+case|what\s+it\s+does|examples?|references?)"
)

#: Alias of each dialect name; fixed values.
DIALECT_ALIASES = {
    "sentinel": "sentinel", "log-analytics": "sentinel", "loganalytics": "sentinel", "microsoft-sentinel": "sentinel",
    "defender-xdr": "defender-xdr", "advanced-hunting": "defender-xdr", "microsoft-defender-xdr": "defender-xdr",
    "adx": "azure-data-explorer", "kusto": "azure-data-explorer", "azure-data-explorer": "azure-data-explorer", "fabric": "azure-data-explorer",
    "arg": "azure-resource-graph", "resource-graph": "azure-resource-graph", "azure-resource-graph": "azure-resource-graph",
    "intune": "intune-device-query", "device-query": "intune-device-query", "intune-device-query": "intune-device-query",
}

ACCENTS = ("àâäáãéèêëíìîïóòôöõúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")


#: Literals of which a text must hold one, in lower case, before a rule's pattern is tried; rules that are not here are tried always.
NEEDLES = {
    "github-token": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"], "json-web-token": ["eyj"], "storage-connection-string": ["accountkey="], "bearer-token": ["bearer"],
    "assigned-secret": ["key", "secret", "password", "passwd", "token"], "email": ["@"], "url": ["http", "www."], "ipv4": ["."], "uuid": ["-"],
}


def spark_pattern(pattern: str) -> str:
    """The pattern with its boundaries spelled out: one look where a word must start or end, both ways where that is not sure."""
    pattern = re.sub(r"^(\(\?i\))?\\b(?=[A-Za-z]|\(\?:[A-Za-z])", lambda m: (m[1] or "") + "(?<![A-Za-z0-9_])", pattern)
    pattern = re.sub(r"(?:(?<=[a-z])|(?<=\\d\+))(\)?)\\b$", r"\1(?![A-Za-z0-9_])", pattern)
    return pattern.replace(r"\b", _BOUNDARY)


def needles(name: str, pattern: str) -> list[str]:
    """Literals that a match must contain one of: those of NEEDLES, or the first letters of each alternative."""
    if name in NEEDLES:
        return NEEDLES[name]
    found = re.match(r"(?:\(\?i\))?\\b(?:\(\?:([^()]*(?:\([^()]*\)[^()]*)*)\)|([A-Za-z]+))", pattern)
    words = [re.match("[A-Za-z]*", x)[0].lower() for x in (found[1] or found[2]).split("|")] if found else []
    return words if all(len(w) > 1 for w in words) else []


def _matches(text: Column, low: Column, name: str, pattern: str) -> Column:
    hit, words = F.rlike(text, F.lit(spark_pattern(pattern))), needles(name, pattern)
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words)) & hit if words else hit


def matched_rules(text: Column, rules: Sequence[tuple[str, str]], prefix: str = "") -> Column:
    """Names of the rules that match, in the rules' order, as an array. Patterns are tried only where a literal of theirs occurs.

    The text and its lower case are bound once, by a transform over one element, however many rules look at them.
    """
    names = lambda x: F.array_compact(F.array(*(F.when(_matches(x["text"], x["low"], name, prefix + p), F.lit(name)) for name, p in rules)))
    return F.element_at(F.transform(F.array(F.struct(text.alias("text"), F.lower(text).alias("low"))), names), 1)


def sql_rules(text: str, rules: Sequence[tuple[str, str]], prefix: str = "") -> str:
    """The same as text joined by a bar, in SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return "concat_ws('|', " + ", ".join(f"CASE WHEN regexp_matches({text}, {quote(prefix + p)}) THEN {quote(n)} END" for n, p in rules) + ")"


def normalize_body(text: Column) -> Column:
    """No byte order mark, LF line ends, no trailing blanks, no outer blank lines, one blank line at most."""
    for pattern, by in BODY_STEPS:
        text = F.regexp_replace(text, pattern, by.replace("\\1", "$1"))
    return text


BODY_STEPS = [("^﻿", ""), ("\\r\\n?", "\n"), ("[ \\t]+(\\n|\\z)", "\\1"), ("\\A\\n+", ""), ("\\n+\\z", ""), ("\\n{3,}", "\n\n")]


def sql_normalize_body(text: str) -> str:
    for pattern, by in BODY_STEPS:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return text


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \\t\\r\\n\\f]+", " "))


def stable_id(prefix: str, value: Column) -> Column:
    """prefix, underscore and the first 32 hex digits of SHA-256."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(value, 256), 1, 32))


def source_identity(repository: Column, path: Column, block: Column) -> Column:
    return F.concat_ws(":", F.lower(repository), path, block.cast("string"))


def dedupe_key(body: Column, dialect: Column, identity: Column) -> Column:
    nul = F.char(F.lit(0))
    return F.sha2(F.concat(normalize_body(body), nul, dialect, nul, identity), 256)


def content_hash(**fields: Column) -> Column:
    """SHA-256 of the JSON object with the fields in the order given; nulls are written."""
    return F.sha2(F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())), {"ignoreNullFields": "false"}), 256)


def title_from_path(path: Column) -> Column:
    """The file name's stem with words parted."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, "(.)\\.[^.]*\\z", "$1")
    words = F.regexp_replace(F.regexp_replace(stem, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    title = F.substring(collapse(F.regexp_replace(words, "[_-]+", " ")), 1, 180)
    return F.when(title == "", "Untitled query").otherwise(title)


def is_generic_title(title: Column) -> Column:
    """True where every part of the title is a product or a filler word."""
    t = collapse(title)
    for pattern in GENERIC_STEPS:
        t = F.regexp_replace(t, pattern, "")
    parts = F.filter(F.split(t, GENERIC_SPLIT), lambda x: x != "")
    fixed = F.rlike(t, F.lit("(?i)^(?:update\\s+the(?:\\s+query)?|follow[-\\s]?up\\s+pivots?(?:\\s*\\(\\s*recommended\\s*\\))?)$"))
    return (t == "") | fixed | F.forall(parts, lambda x: F.rlike(x, F.lit(f"(?i)^{GENERIC_PART}$")))


GENERIC_STEPS = ["^\\d+[.)]\\s*", "\\s*(?:#|[-:])?\\s*\\d+$", "(?i)^the\\s+", "(?i)\\s+(?:query|queries|kql)$"]
GENERIC_SPLIT = "(?i)\\s*(?:/|&|\\+|,|\\(|\\)|\\s+-\\s+|\\band\\b)\\s*"


def strip_strings(array: Column) -> Column:
    """The string members of a JSON array in text; anything else gives an empty array."""
    members = F.filter(F.try_variant_get(F.try_parse_json(array), "$", "array<variant>"), lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(members, lambda v: F.variant_get(v, "$", "string")), F.array().cast("array<string>"))


def _spellings(values: Column, which: str) -> Column:
    # sorted by lower case and place, so that a word's spellings are neighbours; n log n, whatever the number of words
    ranked = F.sort_array(F.transform(values, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("at"), x.alias("word"))))

    def groups(r: Column) -> Column:
        differs = lambda x, i, by: F.coalesce(F.get(r, i + by)["low"] != x["low"], F.lit(True))
        firsts, lasts = F.filter(r, lambda x, i: (i == 0) | differs(x, i, -1)), F.filter(r, lambda x, i: differs(x, i, 1))
        # as many first ones as last ones, word by word
        pairs = F.arrays_zip(firsts.alias("f"), (firsts if which == "first" else lasts).alias("w"))
        return F.transform(pairs, lambda z: F.struct(z["f"]["at"].alias("at"), z["w"]["word"].alias("word")))

    return F.transform(F.sort_array(F.get(F.transform(F.array(ranked), groups), F.lit(0))), lambda x: x["word"])


def first_spelling(values: Column) -> Column:
    """Distinct whatever the case; the first spelling stays, in its place."""
    return _spellings(values, "first")


def last_spelling(values: Column) -> Column:
    """Distinct whatever the case; the last spelling stays, in the first one's place."""
    return _spellings(values, "last")


def has_identifier(text: Column, name: Column) -> Column:
    """Whether a name stands in the text as a whole identifier; its own signs are taken literally."""
    literal = F.regexp_replace(name, "([^A-Za-z0-9_])", "\\\\$1")
    return F.rlike(text, F.concat(F.lit("(?<![A-Za-z0-9_])"), literal, F.lit("(?![A-Za-z0-9_])")))


def dialect_of(name: Column) -> Column:
    """The dialect that an alias names, or null."""
    pairs = [F.lit(x) for kv in DIALECT_ALIASES.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.lower(F.trim(name)))


def embedding_text(row_title="title") -> Column:
    """Title, dialect, lists, description and body, empty parts left out, parted by blank lines."""
    part = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(c, ", ")))
    return F.concat_ws(
        "\n\n", F.nullif(F.col(row_title), F.lit("")), F.concat(F.lit("Dialect: "), F.col("dialect")), part("Tables", "tables"), part("Operators", "operators"), part("Tags", "tags"),
        F.nullif(F.col("description"), F.lit("")), F.nullif(F.col("kql"), F.lit("")),
    )
