"""What was known at a time: versions of texts with the stretch in which they stood, threads as they were, signals read again.

A cutoff on creation times is not enough: a text that was edited later would show what it says today, and the files, errors and symbols of
a thread would hold what later texts brought. So texts are taken from their versions, the current ones and those that an edit or a
deletion superseded, by an interval test, and every signal that prose can give is extracted again from what stood then. A
pull request's file list counts from its merge on: before that, only a part of it existed, which nobody recorded.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import extract
from threadloom.functions.text import definitive_path

KEY = ("repo", "number")
PART = ("repo", "number", "source_type", "source_id", "chunk_index")


def versions(current: DataFrame, history: DataFrame | None, key: Sequence[str] = PART, created: str = "created_at", superseded: str = "superseded_at") -> DataFrame:
    """current and superseded rows with valid_from and valid_to: a version stands from the end of the one before, or from its creation."""
    rows = current.withColumn("valid_to", F.lit(None).cast("timestamp"))
    if history is not None:
        old = history.withColumn("valid_to", F.col(superseded).cast("timestamp"))
        rows = rows.unionByName(old.select(*(F.col(c) if c in old.columns else F.lit(None).cast(current.schema[c].dataType).alias(c) for c in current.columns), "valid_to"))
    before = Window.partitionBy(*key).orderBy(F.col("valid_to").asc_nulls_last())
    return rows.withColumn("valid_from", F.coalesce(F.lag("valid_to").over(before), F.col(created).cast("timestamp")))


def stood_at(at: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Whether a version stood just before a time. Undated versions never did."""
    return F.coalesce(F.col(start) < at, F.lit(False)) & (F.col(end).isNull() | (F.col(end) >= at))


def threads_at(threads: DataFrame, before: datetime) -> DataFrame:
    """Threads that existed, without what happened to them later: merged, closed or touched again after the cutoff is not so yet."""
    at = F.lit(before)
    rows = threads.where(F.coalesce(F.col("created_at") < at, F.lit(False)))
    later = {c: F.when(F.col(c) < at, F.col(c)) for c in ("updated_at", "merged_at", "closed_at") if c in threads.columns}
    if "state" in threads.columns:
        ended = [F.col(c) < at for c in ("closed_at", "merged_at") if c in threads.columns]
        since = F.coalesce(*(F.when(e, True) for e in ended), F.lit(False)) if ended else F.lit(False)
        later["state"] = F.when(since, F.col("state")).otherwise("open")
    if "events" in threads.columns:
        later["events"] = F.when(F.coalesce(F.col("closed_at"), F.col("merged_at")) < at, F.col("events"))
    return rows.withColumns(later)


def rejoined_texts(documents: DataFrame, key: Sequence[str] = ("repo", "number", "source_type", "source_id"), body: str = "body_markdown") -> DataFrame:
    """One row a source: its chunks with a blank line between, and its first chunk's time and metadata. A source has a bounded number of chunks."""
    more = [c for c in ("author", "created_at", "metadata") if c in documents.columns]
    first = [F.min_by(c, "chunk_index").alias(c) for c in more]
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", F.coalesce(body, F.lit("")).alias("body"))))
    return documents.groupBy(*key).agg(F.array_join(F.transform(parts, lambda p: p["body"]), "\n\n").alias("markdown"), *first)


def signals_at(texts: DataFrame, threads: DataFrame, files: DataFrame, before: datetime, key: Sequence[str] = KEY) -> dict[str, DataFrame]:
    """files, errors, tests, symbols and links as the texts of the time say them.

    texts: rejoined, with metadata where they have any; threads: as they were, with thread_type and merged_at; files: the stored ones, of
    which the changed files of pull requests that were merged by then are kept.
    """
    hunk = F.get_json_object("metadata", "$.diff_hunk") if "metadata" in texts.columns else F.lit(None).cast("string")
    text = F.concat_ws("\n", "markdown", hunk)
    said = extract.paths(texts, text, *key).select(*key, "path", F.lit("mentioned").alias("source"))
    if "metadata" in texts.columns:
        anchored = texts.select(*key, definitive_path(F.get_json_object("metadata", "$.path")).alias("path"), F.lit("comment").alias("source")).where("path is not null")
        said = said.unionByName(anchored)
    merged = threads.where(F.coalesce(F.col("merged_at") < F.lit(before), F.lit(False))).select(*key)
    changed = files.where("source = 'changed'").join(merged, list(key), "left_semi").select(*key, "path", "source")
    level = F.when(F.col("source") == "changed", 0).when(F.col("source") == "comment", 1).otherwise(2)
    found = {
        "files": said.unionByName(changed).groupBy(*key, "path").agg(F.min_by("source", level).alias("source")),
        "errors": extract.errors(texts, text, *key),
        "tests": extract.tests(texts, text, *key),
        "symbols": extract.symbols(texts, text, *key),
    }
    if "thread_type" in threads.columns and "source_type" in texts.columns:
        heads = threads.select(*key, "thread_type")
        found["links"] = extract.links(texts.join(heads, list(key)), F.col("markdown"), *key).withColumn("relationship", F.lit("closes"))
    return found
