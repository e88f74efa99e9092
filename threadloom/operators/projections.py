"""Results as JSON texts for callers: one object a hit, a claim or a comment, and whole pages of them.

An object is put together from JSON texts, so that a key can be left out where nobody measured its value, which null would not say. Arrays hold
pages that are bounded before they come here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import age, stamp
from threadloom.operators.filters import KEY

#: The keys of the served objects, and the columns that they come from where these have another name.
HIT = ("repo", "number", "type", "title", "source_type", "url", "author", "trust", "age", "date", "snippet", "document_id", "source_id", "chunk_index")
CLAIM = ("repo", "number", "type", "title", "url", "author", "state", "draft", "merged", "state_reason", "closed_by", "review_decision", "age", "date", "relationship")
OUTLINE = ("id", "source_type", "author", "trust", "age", "date", "url", "passages", "snippet")
THREAD = ("repo", "number", "type", "title", "url", "author", "state", "age", "date", "labels", "state_reason", "closed_by", "merged", "review_decision", "body", "body_chars", "body_truncated")
COLUMNS = {"type": "thread_type", "url": "html_url"}


def text_of(value: Column) -> Column:
    """A value as JSON; null is null."""
    listed = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substring(listed, 2, F.length(listed) - 2)


def object_of(fields: Sequence[tuple[str, Column]], measured: Sequence[tuple[str, Column]] = ()) -> Column:
    """An object of JSON texts by key. Of `measured`, those that are null are left out."""
    pairs = [F.concat(F.lit(f'"{k}":'), F.coalesce(v, F.lit("null"))) for k, v in fields]
    pairs += [F.concat(F.lit(f'"{k}":'), v) for k, v in measured]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def array_of(rows: DataFrame, key: Sequence[str], order: Sequence[str], text: Column, name: str) -> DataFrame:
    """(key, name, name_returned): the texts of each key's rows as an array, in order."""
    listed = F.array_sort(F.collect_list(F.struct(*order, text.alias("text_"))))
    made = F.concat(F.lit("["), F.array_join(F.transform(listed, lambda r: r["text_"]), ","), F.lit("]"))
    return rows.groupBy(*key).agg(made.alias(name), F.count("*").alias(f"{name}_returned"))


def _named(rows: DataFrame, keys: Sequence[str], now: Column, **more: Column) -> list[tuple[str, Column]]:
    """The keys with their columns as JSON. Age and date come from created_at; a column that the rows do not have is null."""
    more = {"age": age(F.col("created_at"), now), "date": stamp(F.col("created_at"))} | more
    found = lambda k: F.col(COLUMNS.get(k, k)) if COLUMNS.get(k, k) in rows.columns else F.lit(None).cast("string")
    return [(k, text_of(more[k] if k in more else found(k))) for k in keys]


def hit_json(rows: DataFrame, now: Column, compact: bool = False) -> Column:
    """One hit of a page. passages and truncated are there only where they were measured; scores are left out of compact hits."""
    part = F.concat_ws(":", "source_type", F.col("source_id").cast("string"), F.col("chunk_index").cast("string"))
    measured = []
    if "passages" in rows.columns:
        measured.append(("passages", F.when(F.col("passages") > 0, text_of(F.col("passages")))))
    if "truncated" in rows.columns:
        measured.append(("truncated", F.when(F.col("truncated"), F.lit("true"))))
    if not compact and "score" in rows.columns:
        measured.append(("score", F.when(F.col("score").isNotNull(), text_of(F.round("score", 6)))))
        if "breakdown" in rows.columns:
            measured.append(("breakdown", F.to_json(F.transform_values("breakdown", lambda k, v: F.round(v, 6)))))
    return object_of(_named(rows, HIT, now, document_id=part), measured)


def claim_json(rows: DataFrame, now: Column) -> Column:
    """The head of one thread that claims to close another."""
    merged = {"merged": F.col("merged_at").isNotNull()} if "merged_at" in rows.columns else {}
    return object_of(_named(rows, CLAIM, now, **merged))


def outline_json(rows: DataFrame, now: Column) -> Column:
    """One line of an outline: what it takes to choose a comment, and nothing to quote it by."""
    return object_of(_named(rows, OUTLINE, now, id=F.col("source_id")))


def inflight_json(asked: DataFrame, claims: DataFrame, links: DataFrame, now: Column) -> DataFrame:
    """(repo, number, json) for each asked thread, those that nobody claims among them.

    claims: of operators.threads.claims, cut at its cap, with their total. links_indexed tells an index without any link of the repository from a
    thread without claims.
    """
    made = array_of(claims.withColumn("number_", F.col("target_number")), ["repo", "number_"], ["position"], claim_json(claims, now), "claims")
    totals = claims.groupBy("repo", F.col("target_number").alias("number_")).agg(F.max("total").alias("total"))
    indexed = links.groupBy("repo").agg(F.count("*").alias("links_indexed"))
    rows = asked.select(*KEY).distinct().withColumn("number_", F.col("number")).join(made, ["repo", "number_"], "left").join(totals, ["repo", "number_"], "left").join(indexed, "repo", "left")
    none = lambda c: text_of(F.coalesce(c, F.lit(0).cast("long")))
    fields = [("repo", text_of(F.col("repo"))), ("number", text_of(F.col("number"))), ("claims", F.coalesce("claims", F.lit("[]")))]
    fields += [("claims_returned", none("claims_returned")), ("claims_total", none("total")), ("links_indexed", none("links_indexed"))]
    return rows.select(*KEY, object_of(fields).alias("json"))


def thread_json(heads: DataFrame, comments: DataFrame, counts: DataFrame, files: DataFrame, now: Column, compact: bool = False) -> DataFrame:
    """(repo, number, json): heads with the comments of their page, the counts behind the page, and their files by where they come from.

    comments: a bounded page with `position`; counts: (repo, number, comments_total, comments_machine_suppressed); files: (repo, number, path, source).
    """
    key = list(KEY)
    page = array_of(comments, key, ["position"], hit_json(comments, now, compact), "comments")
    by = lambda source: F.array_sort(F.collect_set(F.when(F.col("source") == source, F.col("path"))))
    paths = files.groupBy(*key).agg(by("changed").alias("files_changed"), by("comment").alias("files_anchored"), by("mentioned").alias("files_mentioned"))
    merged = {"merged": F.col("merged_at").isNotNull()} if "merged_at" in heads.columns else {}
    rows = heads.join(page, key, "left").join(counts, key, "left").join(paths, key, "left")
    none = lambda c: text_of(F.coalesce(c, F.lit(0).cast("long")))
    paths_of = [(c, text_of(F.coalesce(c, F.array().cast("array<string>")))) for c in ("files_changed", "files_anchored", "files_mentioned")]
    fields = _named(heads, THREAD, now, **merged) + paths_of + [("comments", F.coalesce("comments", F.lit("[]"))), ("comments_returned", none("comments_returned"))]
    fields += [(c, none(c)) for c in ("comments_total", "comments_machine_suppressed")]
    return rows.select(*key, object_of(fields).alias("json"))
