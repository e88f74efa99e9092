"""Signals out of text, as Column expressions and explodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import ERROR_LINE, definitive_path, error_norm, is_symbol, repo_path

#: The shapes of signals.
NODE_ID = r"([\w./-]+\.py)::([\w:.-]*\w(?:\[[^\]\n]*\])?)"
DOTTED_TEST = r"\b((?:[A-Za-z_]\w*\.){2,}test_\w+)\b"
PY_FRAME = r'File "([^"\n]+)", line \d+, in ([A-Za-z_]\w*)'
PYTEST_FRAME = r"(?m)^([\w./-]+\.py):\d+: in ([A-Za-z_]\w*)"
DEFINITION = r"(?m)^[+\- ]?\s*(?:async\s+)?(def|class|function)\s+([A-Za-z_]\w*)"
URL = r"(?i)\b[a-z][a-z0-9+.-]*://\S+"
PATH_TOKEN = r"(?<![\w.-])(/?(?:[\w.+-]+/)*[\w.+-]+\.[A-Za-z][A-Za-z0-9]{0,4})(?![\w/])"
FENCE = r"(?s)```[^\n]*\n(.*?)```"
CODE_SPAN = r"`{1,3}([^`\n]+)`{1,3}"
CLOSES = r"(?i)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\b\s*:?\s*#(\d+)"
PARAMETERS = r"\[[^\]]*\]"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _pairs(text: Column, pattern: str) -> Column:
    return F.arrays_zip(_all(text, pattern, 1).alias("a"), _all(text, pattern, 2).alias("b"))


def errors(documents: DataFrame, text: Column, *keep: str) -> DataFrame:
    """(keep, exception_type, message_norm), distinct."""
    found = documents.select(*keep, F.explode(_pairs(text, ERROR_LINE)).alias("m"))
    found = found.select(*keep, F.substring_index("m.a", ".", -1).alias("exception_type"), error_norm(F.col("m.b")).alias("message_norm"))
    return found.where("message_norm <> ''").distinct()


def tests(documents: DataFrame, text: Column, *keep: str) -> DataFrame:
    """(keep, test_id, test_function): ids as written and, where they have parameters, without."""
    ids = F.concat(F.transform(_pairs(text, NODE_ID), lambda m: F.concat(m["a"], F.lit("::"), m["b"])), _all(text, DOTTED_TEST))
    found = documents.select(*keep, F.explode(F.array_distinct(ids)).alias("written"))
    bare = F.regexp_replace("written", PARAMETERS, "")
    function = F.regexp_replace(F.substring_index(F.substring_index("written", "::", -1), ".", -1), PARAMETERS, "")
    found = found.select(*keep, F.explode(F.array_distinct(F.array("written", bare))).alias("test_id"), F.when(F.startswith(function, F.lit("test")), function).alias("test_function"))
    return found.distinct()


def paths(documents: DataFrame, text: Column, *keep: str) -> DataFrame:
    """(keep, path): repository paths that prose, node ids and frames mention."""
    prose = F.regexp_replace(text, URL, " ")
    tokens = F.concat(_all(prose, PATH_TOKEN), _all(text, NODE_ID), _all(text, PY_FRAME), _all(text, PYTEST_FRAME))
    found = documents.select(*keep, F.explode(F.array_distinct(tokens)).alias("token"))
    return found.select(*keep, repo_path(F.col("token")).alias("path")).where("path is not null").distinct()


def symbols(documents: DataFrame, text: Column, *keep: str) -> DataFrame:
    """(keep, symbol, path, symbol_type): frames, definitions and code spans; a typed reading beats one without a type."""
    kind = "symbol string, path string, symbol_type string"

    def rows(pattern: str, make) -> Column:
        return F.transform(_pairs(text, pattern), make)

    def row(symbol, path, symbol_type) -> Column:
        return F.struct(symbol.alias("symbol"), path.cast("string").alias("path"), symbol_type.alias("symbol_type")).cast(f"struct<{kind.replace(' string', ':string')}>")

    spans = F.transform(_all(F.regexp_replace(text, FENCE, " "), CODE_SPAN), lambda s: F.trim(s))
    named = F.transform(spans, lambda s: row(F.regexp_replace(s, r"\(\)$", ""), F.lit(None), F.when(F.endswith(s, F.lit("()")), "call")))
    found = F.concat(
        rows(PY_FRAME, lambda m: row(m["b"], repo_path(m["a"]), F.lit("frame"))),
        rows(PYTEST_FRAME, lambda m: row(m["b"], repo_path(m["a"]), F.lit("frame"))),
        rows(DEFINITION, lambda m: row(m["b"], F.lit(None), F.when(m["a"] == "class", "class").otherwise("function"))),
        F.filter(named, lambda r: is_symbol(r["symbol"])),
    )
    one = documents.select(*keep, F.posexplode(found).alias("at", "s")).select(*keep, "at", "s.*")
    typed = F.min_by("symbol_type", F.struct(F.col("symbol_type").isNull(), "at"))
    return one.groupBy(*keep, "symbol", "path").agg(typed.alias("symbol_type"))


def links(documents: DataFrame, text: Column, *keep: str) -> DataFrame:
    """(keep, target_number): closing keywords in the bodies of pull requests; a thread never closes itself."""
    bodies = documents.where((F.col("thread_type") == "pr") & (F.col("source_type") == "body"))
    found = bodies.select(*keep, F.explode(F.transform(_all(text, CLOSES), lambda n: n.cast("long"))).alias("target_number"))
    return found.where("target_number <> number").distinct()


def closing_references(details: DataFrame, *keep: str) -> DataFrame:
    """(keep, target_number): the issues of its own repository that the forge says a pull request closes."""
    found = details.select(*keep, F.explode("detail.closingIssuesReferences.nodes").alias("n"))
    mine = F.coalesce(F.lower("n.repository.nameWithOwner") == F.lower("repo"), F.lit(True))
    return found.where(mine & F.col("n.number").isNotNull()).select(*keep, F.col("n.number").alias("target_number")).where("target_number <> number").distinct()


def changed_files(details: DataFrame, *keep: str) -> DataFrame:
    """(keep, path, change_type) of the pull request's own file list."""
    found = details.select(*keep, F.explode("detail.files.nodes").alias("f"))
    return found.select(*keep, definitive_path(F.col("f.path")).alias("path"), F.col("f.changeType").alias("change_type")).where("path is not null")


def commits(details: DataFrame, *keep: str) -> DataFrame:
    found = details.select(*keep, F.explode("detail.commits.nodes").alias("c"))
    return found.select(*keep, F.col("c.commit.oid").alias("sha"), F.col("c.commit.messageHeadline").alias("message")).where("sha <> ''").groupBy(*keep, "sha").agg(F.first("message").alias("message"))
