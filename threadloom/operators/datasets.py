"""Evaluation sets as relations: what an example must be, adding to a set, freezing it, and labels that callers send."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.schemas import KINDS

#: Who may judge, what a label may say, and the version of the layout.
JUDGES = ("human", "model")
VERDICTS = ("relevant", "not_relevant", "decisive")
VERSION = 1
ASKED = ("files", "symbols", "errors", "tests")
EXAMPLE = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("query", T.StringType())]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ASKED]
    + [T.StructField("relevant", T.ArrayType(T.StructType([T.StructField("repo", T.StringType()), T.StructField("number", T.LongType()), T.StructField("why", T.StringType())]))), T.StructField("judged_by", T.StringType()), T.StructField("note", T.StringType())]
)
HEADER = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("frozen_at", T.StringType())])


def _empty(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) <= 0


def faults(examples: DataFrame) -> DataFrame:
    """(id, fault) for everything that is wrong with a set. Ids are counted by one aggregation; all else is told by each row alone.

    An example needs a known kind; a query or a filter; and, where somebody judged it, a known judge and a relevant thread. Ids are unique and not null.
    """
    found = F.array(
        F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown slice"),
        F.when(F.col("judged_by").isNotNull() & ~F.col("judged_by").isin(*JUDGES), "unknown judge"),
        F.when(F.col("judged_by").isNotNull() & _empty("relevant"), "judged without a relevant thread"),
        F.when((F.coalesce(F.trim("query"), F.lit("")) == "") & _empty(ASKED[0]) & _empty(ASKED[1]) & _empty(ASKED[2]) & _empty(ASKED[3]), "asks nothing"),
        F.when(F.col("id").isNull(), "no id"),
    )
    own = examples.select("id", F.explode(F.filter(found, lambda f: f.isNotNull())).alias("fault"))
    twice = examples.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate id").alias("fault"))
    return own.unionByName(twice)


def added(known: DataFrame, new: DataFrame) -> DataFrame:
    """A set with the examples whose ids it does not have; of new ones with the same id, one."""
    fresh = new.select(known.columns).join(known.select("id"), "id", "left_anti").dropDuplicates(["id"])
    return known.unionByName(fresh)


def judged(examples: DataFrame) -> DataFrame:
    """What can be scored: candidates that nobody judged would only make a denominator larger."""
    return examples.where("judged_by is not null")


def oldest_floor(windows: DataFrame) -> DataFrame:
    """(repo, since): where a repository's windows begin; null where one of them is open, as it holds everything."""
    return windows.groupBy("repo").agg(F.when(F.count("since") == F.count("*"), F.min("since")).alias("since"))


class Dataset:
    """A set in a folder: examples as JSON lines in the order of their ids, and a header that says whether it is frozen."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def header(self) -> dict | None:
        """None where nothing is stored; ValueError for another version."""
        try:
            row = self.spark.read.schema(HEADER).json(f"{self.path}/header").first()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        if row is None or row["version"] != VERSION:
            raise ValueError(f"{self.path}: version {row and row['version']!r}, expected {VERSION}")
        return row.asDict()

    def examples(self) -> DataFrame:
        return self.spark.read.schema(EXAMPLE).json(f"{self.path}/examples")

    def save(self, examples: DataFrame, freeze: bool = False) -> None:
        """Write a set. ValueError for faulty examples, and for any change of a set that is stored as frozen.

        What is on disk decides, not what a caller remembers: sets rot by a later run that adds to them.
        """
        rows = examples.select([F.col(f.name).cast(f.dataType) for f in EXAMPLE])
        wrong = faults(rows).orderBy("id", "fault").limit(3).collect()
        if wrong:
            raise ValueError("; ".join(f"{r['id']}: {r['fault']}" for r in wrong))
        before = self.header()
        if before and before["frozen_at"]:
            kept = self.examples()
            if not kept.exceptAll(rows).isEmpty() or not rows.exceptAll(kept).isEmpty():
                raise ValueError(f"{self.path} was frozen at {before['frozen_at']}; write a new set")
            return
        at = datetime.now(UTC).isoformat() if freeze else None
        rows.orderBy("id").write.mode("overwrite").json(f"{self.path}/examples", ignoreNullFields=False)
        self.spark.createDataFrame([(VERSION, at)], HEADER).coalesce(1).write.mode("overwrite").json(f"{self.path}/header", ignoreNullFields=False)


def checked_labels(requests: DataFrame, scope: str = "label") -> DataFrame:
    """requests (scopes, verdict, ...) with refused: null for those that may be stored, else why not."""
    why = F.when(~F.coalesce(F.array_contains("scopes", scope), F.lit(False)), "this token may not label")
    why = why.when(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)), "unknown verdict")
    return requests.withColumn("refused", why)


def append_labels(requests: DataFrame, path: str, keep: Sequence[str] = ("query", "kind", "repo", "number", "source_type", "filters", "verdict", "note"), ranking: str = "bm25") -> DataFrame:
    """Append the labels that may be stored as JSON lines, each with its time and with the ranking that it judged; return the checked requests.

    Filters that ask nothing are left out. Labels are no documents: no search reads them.
    """
    rows = checked_labels(requests)
    kept = rows.where("refused is null").select(*(c for c in keep if c in rows.columns))
    if "filters" in kept.columns:
        kept = kept.withColumn("filters", F.map_filter("filters", lambda k, v: F.coalesce(F.size(v), F.lit(0)) > 0))
    kept.withColumns({"labelled_at": F.current_timestamp(), "ranking": F.lit(ranking)}).write.mode("append").json(path)
    return rows
