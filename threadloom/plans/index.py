"""Indexing one batch of fetched payloads: staged, pruned, derived and reconciled, as frames that a caller writes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import thread_number
from threadloom.plans import derive
from threadloom.sources import store
from threadloom.streaming import ingest

OBJECT, THREAD, DOCUMENT = ["repo", "object_type", "object_id"], ["repo", "number"], ["repo", "number", "source_type", "source_id", "chunk_index"]
#: The lists of a thread that a fetch may read in full, so that what it no longer has is gone from the forge.
LISTS = ("issue_comment", "review", "review_comment")


@dataclass(frozen=True)
class Indexed:
    """What a batch leaves: everything staged, the derived rows of the threads that it touched, and what changed."""

    staged: DataFrame
    touched: DataFrame
    threads: DataFrame
    documents: DataFrame  # of all threads
    signals: dict[str, DataFrame]
    changes: DataFrame
    history: DataFrame
    marks: DataFrame


def placed(raw: DataFrame) -> DataFrame:
    """raw with the number of each object's thread: as landed, else from the payload, else from its urls. Numbers that are there stay."""
    if "number" in raw.columns:
        return raw
    at = lambda field: F.get_json_object("payload", f"$.{field}")
    own = F.when(F.col("object_type").isin("issue", "pr", "pr_details"), at("number").cast("long"))
    return raw.withColumn("number", F.coalesce("thread_number", own, thread_number(at("issue_url"), at("pull_request_url"), at("html_url"))))


def received(fetched: DataFrame) -> DataFrame:
    """A batch as it is stored, with the numbers of its threads; rows that have numbers are stored already and stay as they are."""
    return fetched if "number" in fetched.columns else placed(fetched).withColumn("payload", store.without_nul(F.col("payload")))


def staged(raw: DataFrame, fetched: DataFrame, whole: Sequence[str] = LISTS, stage: Callable[[DataFrame, str], DataFrame] = lambda rows, name: rows) -> tuple[DataFrame, DataFrame]:
    """raw after a batch, as two frames: what the batch leaves as it is, and the last version of each other object with `mine_`, whether its
    thread is one of the batch. Comments that a list read in full no longer has are in neither.

    A thread's lists count as read in full when the batch has the thread itself. Joins and windows name the number or the id first, which
    tell rows apart at a glance when they are sorted. Only payloads of the batch's threads and objects meet by object.
    """
    fetched, by_number, by_id = received(fetched), THREAD[::-1], OBJECT[::-1]
    stored = placed(raw)
    read = F.coalesce(F.bool_or(F.col("object_type").isin("issue", "pr")), F.lit(False))
    threads = fetched.where("number is not null").groupBy(*by_number).agg(read.alias("read_"))
    objects = fetched.select(*by_id).distinct()  # a payload that moved to another thread is replaced as well
    moved = stage(stored.select(*OBJECT, *THREAD[1:]).join(threads, by_number, "left_anti").join(objects, by_id, "left_semi").select(*by_id).distinct(), "moved")
    flagged = stored.join(threads.withColumn("mine_", F.lit(True)), by_number, "left").join(moved.withColumn("o_", F.lit(True)), by_id, "left")
    again = F.coalesce("mine_", "o_", F.lit(False))
    others = flagged.where(~again).select(stored.columns)

    mine = F.coalesce("mine_", F.lit(False)).alias("mine_")
    rows = flagged.where(again).select(*stored.columns, mine, F.coalesce("read_", F.lit(False)).alias("read_"), F.lit(False).alias("new_"))
    rows = rows.unionByName(fetched.select(*stored.columns, (F.col("repo").isNotNull() & F.col("number").isNotNull()).alias("mine_"), F.lit(False).alias("read_"), F.lit(True).alias("new_")))
    latest = Window.partitionBy(*by_id).orderBy(F.struct(F.col("updated_at"), F.col("fetched_at")).desc())
    rows = rows.withColumns({"place_": F.row_number().over(latest), "there_": F.max("new_").over(latest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    named = F.col("repo").isNotNull() & F.col("object_id").isNotNull()
    gone = named & F.col("read_") & ~F.col("there_") & F.coalesce(F.col("object_type").isin(*(t for t in LISTS if t in whole)), F.lit(False))
    return others, rows.where((F.col("place_") == 1) & ~gone).select(*stored.columns, "mine_")


def indexed(raw: DataFrame, fetched: DataFrame, documents: DataFrame, authority: DataFrame, marks: DataFrame, results: DataFrame | None = None, whole: Sequence[str] = LISTS, stage: Callable[[DataFrame, str], DataFrame] = lambda rows, name: rows) -> Indexed:
    """Index a batch on top of what is staged (raw), derived (documents) and marked (marks: repo, high_water).

    Only threads that the batch touches are derived again; their documents replace the stored ones, edited and deleted
    text goes into the history, and indexing a batch twice changes nothing. results (repo, ts, ok) say how the fetches
    went; the mark of a repository stops before its first failure and never goes back. stage may write what several results are computed
    from, and read it back; a batch that was received before is not staged again.
    """
    if "number" not in fetched.columns:
        fetched = stage(received(fetched), "fetched")  # payloads are read once for all that asks for their threads
    touched = fetched.select(*THREAD).where("number is not null").distinct()
    others, again = staged(raw, fetched, whole, stage)
    again = stage(again, "raw")
    mine, after = again.where("mine_").drop("number", "mine_"), others.unionByName(again.drop("mine_"))
    texts = stage(derive.sources(mine), "texts")
    wanted = stage(derive.documents(texts, stage(authority, "authority"), stored=True), "wanted")  # the session sees the size of what is written
    stored = documents.join(touched, THREAD, "left_semi")
    changes = store.change_set(stored, wanted, DOCUMENT, ["content_hash", "trust"])
    if results is None:
        results = fetched.select("repo", F.col("updated_at").alias("ts"), F.lit(True).alias("ok"))
    return Indexed(
        after, touched, derive.threads(mine), documents.join(touched, THREAD, "left_anti").unionByName(wanted), derive.signals(texts, mine), changes,
        store.superseded(stored, wanted, DOCUMENT, "content_hash"), store.advanced(marks, ingest.committed_mark(results, ["repo"]).select("repo", "high_water"), ["repo"]),
    )
