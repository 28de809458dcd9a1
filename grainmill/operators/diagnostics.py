"""What is wrong with a query text, with places: policy first, then the rules of restricted dialects over token sequences.

Only texts of restricted dialects are cut into tokens; windows over a text's tokens then see a stage's operator and the tokens that follow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.functions import query_text as q
from grainmill.functions.lexer import lexemes, location

# ---- fixed values
DIALECT_OPERATORS = {
    "azure-resource-graph": "count distinct extend join limit mv-expand mvexpand order parse project project-away sort summarize take top union where".split(),
    "intune-device-query": "count distinct join order project summarize take top where".split(),
}
DIALECT_LABELS = {"azure-resource-graph": "Azure Resource Graph", "intune-device-query": "Intune Device Query"}
GRAPH_JOIN_KINDS = ["fullouter", "inner", "innerunique", "leftouter"]
GRAPH_ROW_LIMIT = 2000
#: Operators that may begin a statement.
LEADING = ["evaluate", "find", "print", "range", "search", "union"]
MOST = 20
POLICY_MESSAGES = {
    "KQL_QUERY_TOO_LARGE": "KQL queries cannot exceed 100,000 characters.", "KQL_EMPTY": "Enter a KQL query, not only whitespace or comments.",
    "KQL_CONTROL_CHARACTER": "The query contains a control character that KQL source cannot use.",
    "KQL_MARKDOWN_NOT_ALLOWED": "Paste the KQL itself without Markdown headings, lists, or code fences.", "KQL_SQL_NOT_ALLOWED": "This input looks like SQL. Only KQL queries can be saved.",
    "KQL_SHELL_NOT_ALLOWED": "This input looks like a shell command. Only KQL queries can be saved.", "KQL_JSON_NOT_ALLOWED": "This input looks like JSON. Only KQL queries can be saved.",
    "KQL_HTML_NOT_ALLOWED": "This input looks like HTML. Only KQL queries can be saved.", "KQL_PLACEHOLDER_NOT_ALLOWED": "Replace template placeholders with concrete KQL before saving.",
}


def dialect_problems(dialect: Column, operators: Column) -> Column:
    """Operators that the dialect does not have."""
    out = F.array().cast("array<string>")
    for name, allowed in DIALECT_OPERATORS.items():
        bad = F.filter(operators, lambda x: ~F.regexp_replace(x, " by$", "").isin(allowed))  # noqa: B023
        out = F.when(dialect == name, bad).otherwise(out)
    return out


def dialect_findings(rows: DataFrame, key: str, body: str, dialect: str, also: Sequence[str] = ()) -> DataFrame:
    """(key, code, message, start, length, line, col) for each place that a restricted dialect does not allow, and the columns ``also`` of its text. ``key`` tells the texts apart."""
    some = rows.where(F.col(dialect).isin(list(DIALECT_OPERATORS))).select(F.col(key), F.col(body), F.col(dialect).alias("_dialect"), *also)
    tokens = lexemes(some, key, body, names=True, also=["_dialect", *also]).where("kind <> 'comment'").withColumn("word", F.lower("token")).drop("token")
    by = Window.partitionBy(key).orderBy("start")
    at = lambda k, c="word": (F.lead(c, k) if k > 0 else F.lag(c, -k)).over(by)
    is_word = F.rlike("word", F.lit("^[a-z_]")) & (F.col("kind") != "string")
    first = F.coalesce(at(-1), F.lit(";")).isin(";", "(", "{", "=") & F.col("word").isin(LEADING)
    stage = F.when(is_word & ((at(-1) == "|") | first), F.col("word"))
    seen = tokens.withColumns({"_own": stage, "_before": at(-1), "_before2": at(-2), "_1": at(1), "_2": at(2), "_3": at(3)}).withColumns({"_stage": F.last("_own", True).over(by), "_4stop": at(4, "stop")})
    label = F.coalesce(*(F.when(F.col("_dialect") == d, F.lit(v)) for d, v in DIALECT_LABELS.items()))
    allowed = F.coalesce(*(F.when(F.col("_dialect") == d, F.col("_own").isin(v)) for d, v in DIALECT_OPERATORS.items()))
    graph = F.col("_dialect") == "azure-resource-graph"
    hit = lambda when, code, message, start=F.col("start"), stop=F.col("stop"): F.when(when, F.struct(F.lit(code).alias("code"), message.alias("message"), start.alias("start"), (stop - start).alias("length")))
    joining = graph & (F.col("_stage") == "join")
    bad_kind = joining & (F.col("_before") == "=") & ~F.col("word").isin(GRAPH_JOIN_KINDS) & (F.col("_before2") == "kind")
    strategy = joining & (F.col("word") == "hint") & (F.col("_1") == ".") & (F.col("_2") == "strategy") & (F.col("_3") == "=")
    number = F.when(F.rlike("word", F.lit("^[0-9]+$")), F.try_to_number("word", F.lit("9" * 38)))
    wide = graph & F.col("_stage").isin("mv-expand", "mvexpand") & (F.col("_before") == "limit") & (F.col("_before2") != "|") & (number > GRAPH_ROW_LIMIT)
    found = F.array_compact(F.array(
        hit(F.col("_own").isNotNull() & ~allowed, "KQL_DIALECT_OPERATOR_NOT_SUPPORTED", F.concat(F.lit("The "), F.col("word"), F.lit(" operator is not supported by "), label, F.lit("."))),
        hit(F.col("word").isin("datatable", "externaldata") & (F.col("_1") == "("), "KQL_DIALECT_OPERATOR_NOT_SUPPORTED", F.concat(F.lit("The "), F.col("word"), F.lit(" source is not supported by "), label, F.lit("."))),
        hit(bad_kind, "KQL_ARG_JOIN_KIND_NOT_SUPPORTED", F.concat(F.lit("Azure Resource Graph does not support join kind="), F.col("word"), F.lit("."))),
        hit(strategy, "KQL_ARG_JOIN_STRATEGY_NOT_SUPPORTED", F.lit("Azure Resource Graph does not support custom join strategies."), stop=F.coalesce("_4stop", "stop")),
        hit(wide, "KQL_ARG_MV_EXPAND_LIMIT", F.lit("Azure Resource Graph limits mv-expand to 2,000 rows.")),
    ))
    return seen.select(key, "line", "col", *also, F.explode(found).alias("d")).select(key, "d.code", "d.message", "d.start", "d.length", "line", "col", *also)


def diagnostics(rows: DataFrame, key: str, body: str, dialect: str) -> DataFrame:
    """(key, place, code, message, start, length, line, col), in order; beyond 20 of a text, 19 and one at its end that says so."""
    # text and policy are made once, by a generator: as plain columns they would be made again for every condition that is pushed down to the text
    some = rows.select(key, F.col(dialect).alias("_of"), F.explode(F.array(F.col(body))).alias("_text")).where("_text is not null")
    broken = some.select("*", F.explode(F.array(q.policy_failure(F.col("_text")))).alias("_p"))
    message = F.coalesce(*(F.when(F.col("_p.code") == c, F.lit(m)) for c, m in POLICY_MESSAGES.items()))
    early = broken.where("_p is not null").select(key, "_p.code", message.alias("message"), "_p.start", "_p.length", "_p.line", "_p.col").withColumn("n", F.lit(1).cast("long"))
    last = location(F.col("_text"), F.length("_text"))
    whole = broken.where("_p is null").where(F.col("_of").isin(list(DIALECT_OPERATORS))).select(key, "_of", "_text", F.length("_text").alias("_end"), last["line"].alias("_line"), last["col"].alias("_col"))
    ends = ["_end", "_line", "_col"]
    ranked = dialect_findings(whole, key, "_text", "_of", ends)
    by = Window.partitionBy(key)
    ranked = ranked.withColumn("place", F.row_number().over(by.orderBy("start", "length", "code", "message"))).withColumn("n", F.count(F.lit(1)).over(by))
    # beyond 20, the twentieth says at the text's end that there are more
    over = (F.col("n") > MOST) & (F.col("place") == MOST)
    instead = {
        "code": F.lit("KQL_DIAGNOSTICS_TRUNCATED"), "message": F.lit(f"Only the first {MOST - 1} syntax errors are shown."), "start": F.col("_end"), "length": F.lit(0), "line": F.col("_line"), "col": F.col("_col"),
    }
    shown = ranked.where(F.col("place") <= MOST).select(key, "place", *(F.when(over, v).otherwise(F.col(k)).alias(k) for k, v in instead.items()))
    cols = [key, "place", "code", "message", "start", "length", "line", "col"]
    return early.withColumn("place", F.lit(1)).select(*cols).unionByName(shown.select(*cols))
