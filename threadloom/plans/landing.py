"""Batches into stored relations: what a batch reads and writes follows the threads that it touches, not the corpus."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cache, partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.plans import derive, index
from threadloom.plans.views import ROWS_A_TASK
from threadloom.schemas import RAW
from threadloom.sources.bucketed import Bucketed
from threadloom.sources.store import nothing

#: Jobs of a batch that run at the same time: most are short and leave cores idle.
AT_ONCE = 4
MARKS = T.StructType().add("repo", "string").add("high_water", "timestamp")


@cache
def _shapes(spark: SparkSession) -> dict[str, T.StructType]:
    """The schema of each relation, as deriving it gives it."""
    none = spark.createDataFrame([], RAW)
    texts = derive.sources(none)
    documents = derive.documents(texts, spark.createDataFrame([], "repo string, login string, permission string")).schema
    found = {"raw": T.StructType([*RAW, T.StructField("number", T.LongType())]), "documents": documents, "threads": derive.threads(none).schema, "marks": MARKS}
    found["history"] = T.StructType([*documents, T.StructField("reason", T.StringType()), T.StructField("superseded_at", T.TimestampType())])
    return found | {n: rows.schema for n, rows in derive.signals(texts, none).items()}


def _together(spark: SparkSession, work: dict[str, Callable]) -> dict:
    """What each piece of work returns; none needs another."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        begun = {name: pool.submit(inheritable_thread_target(spark)(f)) for name, f in work.items()}
        return {name: f.result() for name, f in begun.items()}


@dataclass(frozen=True)
class Landing:
    """The relations of an index in one folder."""

    spark: SparkSession
    path: str
    buckets: int = 64

    def relation(self, name: str) -> Bucketed:
        return Bucketed(self.spark, f"{self.path.rstrip('/')}/{name}", _shapes(self.spark)[name], ("repo",) if name == "marks" else ("repo", "number"), self.buckets)

    def read(self, name: str) -> DataFrame:
        rows = self.relation(name).read()
        return rows.distinct() if name == "history" else rows

    def apply(self, fetched: DataFrame, authority: DataFrame, results: DataFrame | None = None, whole: Sequence[str] = index.LISTS) -> dict[str, int]:
        """Index a batch of payloads on what is stored. Returns the number of document rows by action.

        Payloads of no thread are left out. Everything that the batch changes is computed from the stored rows of its own threads and written aside
        before any relation changes, so that an interrupted batch can be run again. Indexing a batch twice changes nothing.
        whole: the lists of a thread that the batch has in full where it has the thread, so that what is missing there is gone.
        """
        at, aside = self.relation, f"{self.path.rstrip('/')}/batches/{uuid.uuid4().hex}"

        def written(rows: DataFrame, name: str) -> DataFrame:
            rows.write.parquet(f"{aside}/{name}")
            return self.spark.read.schema(rows.schema).parquet(f"{aside}/{name}")

        fetched = written(index.received(fetched.drop("number")), "fetched").where("number is not null")  # numbers are worked out once, not again to be filtered
        keys = written(fetched.select("repo", "number").distinct(), "keys")
        raw, documents = at("raw"), at("documents")
        touched = raw.touched(keys)

        def staged(rows: DataFrame, name: str) -> DataFrame:
            if name == "moved":  # only stored rows of the batch's own threads are given
                return nothing(self.spark, rows.schema)
            if name == "texts":  # they come unevenly out of their kinds of payloads, and all that is made of them reads these files
                parts = self.spark.read.parquet(f"{aside}/on-the-way/raw").count() // ROWS_A_TASK + 1
                rows = rows.repartition(max(self.spark.sparkContext.defaultParallelism, parts), "repo", "number", "source_type", "source_id")
            return written(rows, f"on-the-way/{name}")

        found = index.indexed(raw.of(keys, touched), fetched, documents.of(keys, touched), authority, at("marks").read(), results, whole, stage=staged)
        when = fetched.groupBy("repo", "number").agg(F.max(F.coalesce("updated_at", "fetched_at")).alias("superseded_at"))
        parts = {"raw": index.placed(found.staged), "documents": found.documents, "threads": found.threads} | found.signals

        def marked() -> str | None:
            marks = written(found.marks, "marks")
            return at("marks").prepare(marks, marks)

        work = {name: partial(at(name).prepare, rows, keys, touched) for name, rows in parts.items()} | {"marks": marked}
        work |= {"history": partial(written, found.history.join(when, ["repo", "number"]), "history"), "actions": found.changes.groupBy("action").count().collect}
        ready = _together(self.spark, work)
        at("history").append(ready["history"])  # first: a batch that is run again may add rows twice, which reading undoes, but loses none
        _together(self.spark, {name: partial(at(name).install, ready[name]) for name in parts})
        at("marks").install(ready["marks"])
        return {r["action"]: r["count"] for r in ready["actions"]}
