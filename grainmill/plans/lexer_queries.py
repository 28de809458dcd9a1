"""Tokens, structure, tables, operators and diagnostics of query texts made of the documents' own words and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions import lexer, query_text
from grainmill.functions.lexer import CHUNK
from grainmill.operators import audit, diagnostics, enrichment
from grainmill.plans.catalogue import query
from grainmill.plans.query_bodies import SQL as BODIES
from grainmill.plans.query_bodies import bodies
from grainmill.sources import corpus
from grainmill.sources.corpus import SQL as CORPUS


def _bodies(spark, sf_dir):
    return bodies(corpus.documents(spark, sf_dir)).select("query_id", "dialect", "kql", "body")


# ---- SQL: the same forms for an engine without possessive loops and looks around


def _re(pattern: str) -> str:
    for a, b in (("*+", "*"), ("++", "+"), ("?+", "?"), ("\\Z", "\\z"), (lexer._WORD_END, "\\b")):
        pattern = pattern.replace(a, b)
    return "'" + pattern.replace("'", "''") + "'"


def _mask(text: str, strings: str | None = " ") -> str:
    blank = lambda sign: f"regexp_replace(c, '[^\\n\\r]', '{sign}', 'g')"
    literal = f"WHEN regexp_matches(c, '^(?:@?[\"'']|```|~~~)') THEN {blank(strings)}" if strings is not None else ""
    return f"array_to_string(list_transform(regexp_extract_all({text}, {_re(CHUNK)}), lambda c: CASE WHEN starts_with(c, '//') OR starts_with(c, '/*') THEN {blank(' ')} {literal} ELSE c END), '')"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_WORDS = f"(?:{'|'.join(lexer.HYPHENATED)})\\b|[A-Za-z_][A-Za-z0-9_]*"
_TOKEN = "|".join([*(lexer.KINDS[k] for k in ("comment", "string", "property")), _WORDS, *(lexer.KINDS[k] for k in ("variable", "number", "operator_", "punctuation", "space"))])
TOKENS = f"""pieces AS (SELECT query_id, body, unnest(regexp_extract_all(body, {_re(_TOKEN)})) AS token, generate_subscripts(regexp_extract_all(body, {_re(_TOKEN)}), 1) AS pos FROM q),
placed AS (SELECT *, CAST(sum(length(token)) OVER (PARTITION BY query_id ORDER BY pos) - length(token) AS INTEGER) AS start FROM pieces),
full_ AS (SELECT *, lead(token) OVER (PARTITION BY query_id ORDER BY pos) AS next_ FROM placed WHERE NOT regexp_full_match(token, '\\s+')),
tokens AS (SELECT query_id, body, token, start, CASE WHEN starts_with(token, '//') THEN 'comment' WHEN regexp_matches(token, '^(?:[hH]?@?["'']|```)') THEN 'string' WHEN regexp_matches(token, '^\\[["'']') THEN 'property'
  WHEN token IN {_in(lexer.HYPHENATED)} THEN 'keyword' WHEN token IN {_in(lexer.WORD_OPERATORS)} THEN 'operator' WHEN token IN {_in(lexer.TYPES)} THEN 'type' WHEN token IN {_in(lexer.CONSTANTS)} THEN 'constant'
  WHEN regexp_matches(token, '^[A-Za-z_]') AND next_ = '(' THEN 'function' WHEN token IN {_in(lexer.KEYWORDS)} THEN 'keyword' WHEN regexp_matches(token, '^[A-Za-z_]') THEN 'name' WHEN regexp_matches(token, '^\\$[A-Za-z_]') THEN 'variable'
  WHEN regexp_matches(token, '^\\.?[0-9]') THEN 'number' WHEN token IN {_in(lexer.OPERATORS)} THEN 'operator' WHEN regexp_matches(token, '^[()\\[\\]{{}},;.:]$') THEN 'punctuation' END AS kind FROM full_)"""


@query(f"""WITH {CORPUS}, {BODIES}, {TOKENS},
    cut AS (SELECT query_id, body, kind, start, string_split(token, chr(10)) AS parts, unnest(range(1, len(string_split(token, chr(10))) + 1)) AS i FROM tokens WHERE kind <> 'name'),
    seg AS (SELECT query_id, body, kind, start + length(array_to_string(parts[1:i - 1], chr(10))) + CAST(i > 1 AS INTEGER) AS start, length(parts[i]) AS n FROM cut WHERE parts[i] <> ''),
    mark AS (SELECT *, CASE WHEN lag(kind) OVER w = kind AND lag(start + n) OVER w = start THEN 0 ELSE 1 END AS new_ FROM seg WINDOW w AS (PARTITION BY query_id ORDER BY start)),
    grp AS (SELECT *, sum(new_) OVER (PARTITION BY query_id ORDER BY start) AS g FROM mark),
    span AS (SELECT query_id, any_value(body) AS body, any_value(kind) AS kind, min(start) AS start, max(start + n) AS stop FROM grp GROUP BY query_id, g)
    SELECT query_id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, CAST(len(string_split(left(body, start), chr(10))) AS INTEGER) AS line, CAST(length(split_part(left(body, start), chr(10), -1)) + 1 AS INTEGER) AS col,
      kind, substr(body, CAST(start + 1 AS BIGINT), CAST(stop - start AS BIGINT)) AS token FROM span""")
def lexemes(spark, sf_dir):
    return lexer.lexemes(_bodies(spark, sf_dir), "query_id", "body")


def _nested(value: str, times: int = 12) -> str:
    for _ in range(times):
        value = f"regexp_replace({value}, '\\([^()\\[\\]{{}}]*\\)|\\[[^()\\[\\]{{}}]*\\]|\\{{[^()\\[\\]{{}}]*\\}}', '', 'g')"
    return value


_CLOSED = _re(lexer._CLOSED)


STRUCTURE = f"""m1 AS (SELECT query_id, body, {_mask("body", '"')} AS m, {_mask("body", None)} AS code, len(list_filter(regexp_extract_all(body, {_re(CHUNK)}), lambda c: regexp_matches(c, '^(?:@?["'']|```|~~~|/\\*)') AND NOT regexp_full_match(c, {_CLOSED}))) AS open_ FROM q),
n1 AS (SELECT *, {_nested("m")} AS flat FROM m1),
l1 AS (SELECT *, list_filter(list_transform(string_split(flat, ';'), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')[-1] AS last_ FROM n1),
structure AS (SELECT query_id, code, CASE WHEN trim(body) = '' THEN 'empty' WHEN length(body) > 100000 THEN 'too-long' WHEN open_ > 0 THEN 'unbalanced-quote' WHEN regexp_matches(flat, '[()\\[\\]{{}}]') THEN 'unbalanced-delimiter'
  WHEN regexp_matches(code, '(?i)\\blet\\s+[A-Za-z_][A-Za-z0-9_]*\\s*=\\s*(?:;|\\z)') THEN 'empty-let' WHEN regexp_matches(body, '(?mi)^\\s*//+\\s*let\\s+Function\\s*=') THEN 'commented-wrapper' WHEN last_ IS NULL THEN 'no-result'
  WHEN regexp_matches(last_, '(?i)^(?:alias|declare|let|pattern|restrict|set)\\b') THEN 'ends-with-declaration' WHEN starts_with(last_, '|') THEN 'leading-pipe' WHEN last_ = '...' THEN 'placeholder' END AS problem FROM l1)"""


@query(f"WITH {CORPUS}, {BODIES}, {STRUCTURE} SELECT query_id, problem FROM structure")
def structure_check(spark, sf_dir):
    return _bodies(spark, sf_dir).select("query_id", query_text.structural_problem(F.col("body")).alias("problem"))


def _every(text: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all({text}, {_re(pattern)}, {group})"


def _items(pattern: str) -> str:
    return f"list_reduce(list_concat([CAST([] AS VARCHAR[])], list_transform({_every('m', pattern)}, lambda x: string_split(x, ','))), lambda a, b: list_concat(a, b))"


_N = "[A-Za-z_][A-Za-z0-9_]*"
_TABLES = f"""list_concat(list_transform({_every("body", query_text.TABLE_CALL)}, lambda x: x[2:-2]), {_every("m", query_text.LET_TABLE)}, list_filter({_every("m", query_text.LET_ENTITY)}, lambda x: lower(x) IN {_in(query_text.ENTITIES)}),
  {_every("m", query_text.STATEMENT)}, {_every("m", query_text.CALLED)}, list_filter({_every("m", query_text.ENTITY)}, lambda x: lower(x) IN {_in(query_text.ENTITIES)}),
  list_filter(list_transform(list_zip({_every("m", query_text.JOINED)}, {_every("m", query_text.JOINED, 2)}), lambda x: CASE WHEN x[2] = '' THEN x[1] ELSE '' END), lambda x: x <> ''),
  list_transform(list_filter({_items(query_text.UNION)}, lambda x: NOT regexp_matches(x, '\\A[\\s(]*{_N}\\*?\\s*\\(')), lambda x: regexp_extract(x, '\\A\\s*\\(*\\s*({_N}\\*?)', 1)),
  list_transform({_items(query_text.FOUND)}, lambda x: regexp_extract(x, '\\A\\s*({_N}\\*?)', 1)))"""
METADATA = f"""m AS (SELECT query_id, dialect, body, {_mask("body")} AS m FROM q),
t AS (SELECT query_id, unnest({_TABLES}) AS name, generate_subscripts({_TABLES}, 1) AS pos, list_transform({_every("m", query_text.LET_NAME)}, lambda x: lower(x)) AS lets FROM m),
u AS (SELECT query_id, arg_min(name, pos) AS name, min(pos) AS pos FROM t WHERE name <> '' AND lower(name) NOT IN {_in(query_text.NO_TABLES)} AND NOT list_contains(lets, lower(name)) GROUP BY query_id, lower(name)),
tables_ AS (SELECT query_id, string_agg(name, '|' ORDER BY pos) AS tables FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS k FROM u) WHERE k <= 64 GROUP BY query_id),
o AS (SELECT query_id, dialect, list_transform({_every("m", query_text.OPERATOR)}, lambda x: CASE WHEN regexp_matches(x, '(?i)^(?:order|sort)\\s+by$') AND ends_with(x, 'by') THEN lower(regexp_extract(x, '^([A-Za-z]+)', 1)) || ' by' ELSE lower(regexp_extract(x, '^([A-Za-z0-9-]+)', 1)) END) AS ops FROM m),
p AS (SELECT query_id, dialect, unnest(ops) AS op, generate_subscripts(ops, 1) AS pos FROM o),
ops AS (SELECT query_id, dialect, op, min(pos) AS pos FROM p GROUP BY ALL)"""


@query(f"""WITH {CORPUS}, {BODIES}, {METADATA}, a AS (SELECT query_id, string_agg(op, '|' ORDER BY pos) AS operators FROM ops GROUP BY query_id)
    SELECT query_id, coalesce(operators, '') AS operators, coalesce(tables, '') AS tables FROM q LEFT JOIN a USING (query_id) LEFT JOIN tables_ USING (query_id)""")
def metadata_extract(spark, sf_dir):
    rows = _bodies(spark, sf_dir)
    return rows.select("query_id", F.array_join(query_text.pipe_operators(F.col("body")), "|").alias("operators"), F.array_join(query_text.source_tables(F.col("body")), "|").alias("tables"))


@query(f"""WITH {CORPUS}, {BODIES}, {METADATA}, a AS (SELECT query_id, string_agg(op, '|' ORDER BY pos) AS problems FROM ops
      WHERE (dialect = 'azure-resource-graph' AND replace(op, ' by', '') NOT IN {_in(diagnostics.DIALECT_OPERATORS["azure-resource-graph"])}) OR (dialect = 'intune-device-query' AND replace(op, ' by', '') NOT IN {_in(diagnostics.DIALECT_OPERATORS["intune-device-query"])}) GROUP BY query_id)
    SELECT query_id, coalesce(problems, '') AS problems FROM q LEFT JOIN a USING (query_id)""")
def dialect_check(spark, sf_dir):
    rows = _bodies(spark, sf_dir)
    return rows.select("query_id", F.array_join(diagnostics.dialect_problems(F.col("dialect"), query_text.pipe_operators(F.col("body"))), "|").alias("problems"))


_GRAPH = f"""sized AS (SELECT *, start + length(token) AS stop, lower(token) AS word FROM tokens JOIN (SELECT query_id, dialect FROM q WHERE dialect = 'azure-resource-graph') USING (query_id) WHERE kind <> 'comment'),
near AS (SELECT *, lag(word) OVER w AS b1, lag(word, 2) OVER w AS b2, CASE WHEN regexp_matches(token, '^[A-Za-z_]') AND (lag(word) OVER w = '|' OR (coalesce(lag(word) OVER w, ';') IN (';', '(', '{{', '=') AND word IN {_in(diagnostics.LEADING)})) THEN word END AS own FROM sized WINDOW w AS (PARTITION BY query_id ORDER BY start)),
stage AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY query_id ORDER BY start) AS stage FROM near),
found AS (
  SELECT query_id, body, start, stop, 'KQL_DIALECT_OPERATOR_NOT_SUPPORTED' AS code FROM stage WHERE own NOT IN {_in(diagnostics.DIALECT_OPERATORS["azure-resource-graph"])}
  UNION ALL SELECT query_id, body, start, stop, 'KQL_ARG_JOIN_KIND_NOT_SUPPORTED' FROM stage WHERE stage = 'join' AND b1 = '=' AND b2 = 'kind' AND word NOT IN {_in(diagnostics.GRAPH_JOIN_KINDS)}
  UNION ALL SELECT query_id, body, start, stop, 'KQL_ARG_MV_EXPAND_LIMIT' FROM stage WHERE stage IN ('mv-expand', 'mvexpand') AND b1 = 'limit' AND b2 <> '|' AND try_cast(word AS BIGINT) > 2000)"""


@query(f"""WITH {CORPUS}, {BODIES}, {TOKENS}, {_GRAPH}
    , ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY start, stop - start, code) AS place, count(*) OVER (PARTITION BY query_id) AS n FROM found WHERE length(body) <= 100000),
    shown AS (SELECT query_id, body, place, code, start, stop FROM ranked WHERE n <= 20 OR place < 20 UNION ALL SELECT query_id, body, 20, 'KQL_DIAGNOSTICS_TRUNCATED', length(body), length(body) FROM ranked WHERE n > 20 AND place = 20
      UNION ALL SELECT query_id, body, 1, 'KQL_QUERY_TOO_LARGE', 100000, length(body) FROM q WHERE length(body) > 100000)
    SELECT query_id, CAST(place AS INTEGER) AS place, code, CAST(start AS INTEGER) AS start, CAST(stop - start AS INTEGER) AS length,
      CAST(len(string_split(left(body, CAST(start AS BIGINT)), chr(10))) AS INTEGER) AS line, CAST(length(split_part(left(body, CAST(start AS BIGINT)), chr(10), -1)) + 1 AS INTEGER) AS col FROM shown""")
def dialect_diagnostics(spark, sf_dir):
    """Some bodies are too large, some have tables of their own and so more than 20 findings."""
    return diagnostics.diagnostics(_bodies(spark, sf_dir), "query_id", "body", "dialect").drop("message")


@query()
def derived_tags(spark, sf_dir):
    rows = _bodies(spark, sf_dir)
    body, none = F.col("body"), F.lit("")
    tags = enrichment.derived_tags(F.col("dialect"), none, none, F.concat("query_id", F.lit(".kql")), body, query_text.source_tables(body), query_text.pipe_operators(body))
    return rows.select("query_id", F.array_join(tags, "|").alias("tags"))


#: Tables of a list that a model might propose; those count that stand in the text.
PROPOSED = ["Events", "SigninLogs", "Limit", "bin", "deviceevents"]


@query(f"""WITH {CORPUS}, {BODIES}, {METADATA}, have AS (SELECT query_id, lower(name) AS low, name, pos FROM u UNION ALL
      SELECT query_id, lower(p), p, 1000 + k FROM q, (SELECT unnest({PROPOSED}) AS p, generate_subscripts({PROPOSED}, 1) AS k) WHERE regexp_matches(body, '(?i)(?:^|[^A-Za-z0-9_])' || p || '(?:$|[^A-Za-z0-9_])')),
    one AS (SELECT query_id, arg_min(name, pos) AS name, min(pos) AS pos FROM have GROUP BY query_id, low), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS k FROM one)
    SELECT query_id, string_agg(name, '|' ORDER BY pos) AS tables FROM r WHERE k <= 20 GROUP BY query_id""")
def verified_tables(spark, sf_dir):
    body = F.col("body")
    kept = query_text.kept_tables(body, query_text.source_tables(body), F.array(*map(F.lit, PROPOSED)))
    return _bodies(spark, sf_dir).select("query_id", F.array_join(kept, "|").alias("tables"))


_SENTENCE = "'" + query_text._SENTENCE.replace("(?md)", "(?m)").replace("(?=$|[;\\n])", "(?:$|[;\\n])").replace("(?![a-z0-9_])", "\\b").replace("'", "''") + "'"
_WRAPPED = f"len(list_filter(string_split(code, chr(10)), lambda x: regexp_matches(x, '{audit.WRAPPER.replace(chr(39), chr(39) * 2)}') AND NOT regexp_matches(x, '{audit.TYPED}'))) > 0"


@query(f"""WITH {CORPUS}, {BODIES.replace("q AS (", "bodies AS (")}, q AS (SELECT query_id, CASE WHEN length(kql) % 2 = 0 THEN body ELSE kql END AS body FROM bodies), {STRUCTURE}
    SELECT query_id, 'invalid-structure' AS code FROM structure WHERE problem IS NOT NULL UNION ALL
    SELECT query_id, 'prose-wrapper' FROM structure JOIN (SELECT query_id, {_mask("body")} AS m FROM q) USING (query_id) WHERE {_WRAPPED} OR regexp_matches(m, {_SENTENCE})""")
def audit_texts(spark, sf_dir):
    """Half of the texts are bodies, half the documents' own prose."""
    rows = _bodies(spark, sf_dir).withColumn("kql", F.when(F.length("kql") % 2 == 0, F.col("body")).otherwise(F.col("kql")))
    rows = rows.withColumns({"version_known": F.lit(True), "description": F.lit("d"), "title": F.lit("x"), "tags": F.array(F.lit("t")), "tables": F.array(F.lit("T"))})
    return audit.findings(rows)
