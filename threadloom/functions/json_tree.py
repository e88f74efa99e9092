"""JSON texts of any shape: every string mapped where it stands, and payloads without what mirrors other objects."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from threadloom.functions.text import scrub

#: A string literal, a run of anything else, or a quotation mark that opens no literal. Possessive, so that long strings need no stack.
_PART = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"]++|"'

#: Fields that repeat links of other objects, and what stays of an account.
MIRRORS = ("_links", "performed_via_github_app", "repository", "url")
KEPT_LINK = "html_url"
ACCOUNT = ("id", "login", "site_admin", "type")


def map_strings(text: Column, change: Callable[[Column], Column]) -> Column:
    """A JSON text with each of its strings changed, keys included, at any depth and without a schema.

    The text is cut into literals and what stands between them, so numbers, their precision and the order of fields stay as they are. Null stays null;
    of a text that is no JSON, what is not a literal stays. A literal with an escape that JSON does not have stays as it is.
    """

    def changed(part: Column) -> Column:
        value = F.from_json(F.concat(F.lit("["), part, F.lit("]")), "array<string>")[0]
        new = F.to_json(F.array(change(value)))
        return F.when(F.startswith(part, F.lit('"')) & value.isNotNull(), F.substring(new, 2, F.length(new) - 2)).otherwise(part)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s){_PART}"), F.lit(0)), changed), "")


def scrub_tree(text: Column) -> Column:
    """A JSON text whose strings have all been scrubbed, so that no field can be forgotten."""
    return map_strings(text, scrub)


def strip_tree(value):
    """A parsed payload without mirrored links, and with accounts reduced to who they are. Walks without recursion."""
    root = [value]
    todo: list = [root]
    while todo:
        at = todo.pop()
        for k, v in list(at.items() if isinstance(at, dict) else enumerate(at)):
            if isinstance(v, dict):
                account = "login" in v and "type" in v
                at[k] = v = {f: w for f, w in v.items() if (f in ACCOUNT if account else f not in MIRRORS and (not f.endswith("_url") or f == KEPT_LINK))}
                if not account:
                    todo.append(v)
            elif isinstance(v, list):
                todo.append(v)
    return root[0]


@F.pandas_udf(StringType())
def without_mirrors(texts: pd.Series) -> pd.Series:
    """JSON payloads without mirrored links; null, and what is no JSON or too deep for the parser, stays."""

    def one(text):
        try:
            return text if text is None else json.dumps(strip_tree(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return text

    return texts.map(one)
