"""Questions over source files: (path, content) rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.python_code import DEFINITIONS, REFERENCES, provider
from threadloom.operators import substrings
from threadloom.operators.filters import KEY
from threadloom.schemas import MAX_COPIES, MAX_GREP, MAX_GREP_LINE


def grep(files: DataFrame, pattern: str, path: str = "path", content: str = "content", most: int | None = MAX_GREP, index: substrings.Trigrams | None = None) -> DataFrame:
    """(path, line, text) of the lines that match; with a cap, one row more tells that there are more.

    With a trigram index of the files, only files that hold the pattern's trigrams are read; a pattern without any reads all.
    """
    if index is not None:
        files = index.narrowed(files, substrings.of_pattern(pattern))
    lines = files.where(F.col(content).rlike(pattern)).select(path, F.posexplode(F.split(content, "\n")).alias("at", "text")).where(F.col("text").rlike(pattern))
    found = lines.select(path, (F.col("at") + 1).alias("line"), F.substring(F.trim("text"), 1, MAX_GREP_LINE).alias("text"))
    return found if most is None else found.orderBy(path, "line").limit(most + 1)


def thread_weights(hits: DataFrame, files: DataFrame, top: int = 10, key: Sequence[str] = KEY) -> DataFrame:
    """Threads by how many matched lines the files that they touch have."""
    weights = hits.groupBy("path").agg(F.count("*").alias("n"))
    return files.select(*key, "path").distinct().join(weights, "path").groupBy(*key).agg(F.sum("n").alias("weight")).orderBy(F.col("weight").desc(), *key).limit(top)


def _rows(which: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in (DEFINITIONS if which == 1 else REFERENCES).split(", ")]
        for frame in batches:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                p = provider(path)
                if p and p[which] and content is not None:
                    out += p[which](path, bytes(content).decode("utf-8", "replace") if not isinstance(content, str) else content)
            yield pd.DataFrame(out, columns=columns)

    return run


def definitions(files: DataFrame) -> DataFrame:
    return files.select("path", "content").mapInPandas(_rows(1), DEFINITIONS)


def references(files: DataFrame, name: str | None = None) -> DataFrame:
    """Every reference, or those to one name; files that do not have its letters are not parsed."""
    if name is None:
        return files.select("path", "content").mapInPandas(_rows(2), REFERENCES)
    leaf = name.rpartition(".")[2]
    rows = files.where(F.contains(F.col("content").cast("string"), F.lit(leaf))) if leaf.isascii() else files
    return rows.select("path", "content").mapInPandas(_rows(2), REFERENCES).where((F.col("name") == name) | (F.col("qualname") == name))


def enclosing(defs: DataFrame, lines: DataFrame) -> DataFrame:
    """For each (path, line) the innermost definition around it, else the nearest one before, which is not exact."""
    met = lines.join(defs, "path").where("start <= line")
    around = F.col("end") >= F.col("line")
    best = F.max_by(F.struct("qualname", around.alias("exact")), F.struct(around.cast("int"), "start", "qualname"))
    return met.groupBy("path", "line").agg(best.alias("b")).select("path", "line", "b.qualname", "b.exact")


def symbol(defs: DataFrame, name: str) -> DataFrame:
    """One definition of a name: its full name first, then the first by path and line; and how many there are."""
    found = defs.where((F.col("qualname") == name) | (F.col("name") == name))
    order = F.struct(F.when(F.col("qualname") == name, 0).otherwise(1), "path", "start")
    one = found.agg(F.min_by(F.struct(*defs.columns), order).alias("h"), F.count("*").alias("total"))  # combined in each task first
    return one.where("total > 0").select("h.*", "total")


def copies(defs: DataFrame, by: Column | None = None, most: int | None = MAX_COPIES) -> DataFrame:
    """Definitions of one name grouped by the shape of their bodies, the largest groups first."""
    shape = by if by is not None else F.col("shape_hash")
    found = defs.groupBy("name", shape.alias("shape")).agg(F.count("*").alias("copies"), F.countDistinct("body_hash").alias("bodies"), F.min("path").alias("first_path"))
    return found if most is None else found.orderBy(F.col("copies").desc(), "shape").limit(most)


def repo_map(defs: DataFrame, refs: DataFrame) -> DataFrame:
    """Definitions by how often their name is used, shared among all that have it; dunders are left out."""
    uses = refs.where("kind <> 'definition'").groupBy("name").agg(F.count("*").alias("matches"))
    shared = defs.groupBy("name").agg(F.count("*").alias("shared_by"))
    rows = defs.where(~F.col("name").rlike("^__.*__$")).join(shared, "name").join(uses, "name", "left")
    return rows.select("path", "qualname", "name", "start", F.coalesce("matches", F.lit(0)).alias("matches"), "shared_by", (F.coalesce("matches", F.lit(0)) / F.col("shared_by")).alias("weight")).orderBy(F.col("weight").desc(), "path", "start")
