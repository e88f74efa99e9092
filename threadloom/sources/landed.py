"""Landed payloads, source trees and JSON lines as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from threadloom.functions.text import thread_number
from threadloom.schemas import RAW

SKIPPED = ("node_modules", "__pycache__", "build", "dist", "venv", "env", "site-packages", "target", "vendor", "third_party", "coverage", "htmlcov", "eggs", "wheels", "bower_components")
LARGEST_FILE = 2_000_000


def raw_objects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW).json(path)


def raw_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_batch).json(path)


def payloads(raw: DataFrame, kind: str | Sequence[str], schema: StructType) -> DataFrame:
    """The staged objects of a type, or of several, typed. What the schema does not name is dropped, mirror links among it."""
    typed = raw.where(F.col("object_type").isin(*([kind] if isinstance(kind, str) else kind))).withColumn("p", F.from_json("payload", schema))
    return typed.select("repo", "object_id", "thread_number", "fetched_at", "updated_at", "p")


def numbered_by_url(comments: DataFrame) -> DataFrame:
    """The thread that a comment belongs to, from its urls."""
    urls = [F.col(f"p.{c}") for c in ("issue_url", "pull_request_url", "html_url") if c in comments.schema["p"].dataType.names]
    return comments.withColumn("thread_number", F.coalesce("thread_number", thread_number(*urls)))


def source_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of a tree: no hidden or generated folders, no files over LARGEST_FILE bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split("://", 1)[-1].rstrip("/") + "/"
    at = F.locate(base, F.col("path"))
    path = F.substring("path", at + len(base), 1 << 20)
    hidden = F.exists(F.split(path, "/"), lambda s: F.startswith(s, F.lit(".")) | s.isin(*SKIPPED))
    return files.where((F.col("length") <= LARGEST_FILE) & ~hidden).select(path.alias("path"), "content")


def json_lines(spark: SparkSession, path: str, schema: StructType, version: int | None = None) -> DataFrame:
    """Rows of a JSON-lines file; with a version, its first line is a header that must have it."""
    if version is None:
        return spark.read.schema(schema).json(path)
    header = json.loads(spark.read.text(path).where(F.col("value").contains('"dataset"')).first()[0])
    if header["dataset"]["version"] != version:
        raise ValueError(f"version {header['dataset']['version']}, not {version}")
    return spark.read.schema(schema).json(path).where(F.coalesce(*(F.col(f.name).cast("string") for f in schema.fields)).isNotNull())


class PagedSource(DataSource):
    """format("threadloom_pages"): JSON-lines pages page-00001.jsonl ... of a landing folder, one partition a range of pages.

    Options: path, pages, per_partition, since (ISO 8601; older rows are skipped). Pages are in ascending order, as a
    forge lists them; the reader stands for the network side and is the place for its retries.
    """

    @classmethod
    def name(cls) -> str:
        return "threadloom_pages"

    def schema(self) -> str:
        return "page int, updated_at string, payload string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PageReader(self.options)


class _PageReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.since = options["path"], options.get("since", "")
        self.pages, self.step = int(options["pages"]), int(options.get("per_partition", "10"))

    def partitions(self):
        return [InputPartition((a, min(a + self.step, self.pages + 1))) for a in range(1, self.pages + 1, self.step)]

    def read(self, partition) -> Iterator[tuple]:
        for page in range(*partition.value):
            with open(f"{self.path}/page-{page:05d}.jsonl", encoding="utf-8") as lines:
                for line in lines:
                    row = json.loads(line)
                    if row.get("updated_at", "") >= self.since:
                        yield page, row.get("updated_at"), line.rstrip("\n")
