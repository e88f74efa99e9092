"""Change-sets: what an upsert, a prune or a reconcile writes."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where a single machine runs everything."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='threadloom-')}")
    return spark.conf.get("spark.checkpoint.dir")


def nothing(spark: SparkSession, schema: StructType) -> DataFrame:
    """No rows. Plans leave out what joins them; without the filter Python workers would be asked for them."""
    return spark.createDataFrame([], schema).where(F.lit(False))


def latest(raw: DataFrame, key: Sequence[str], at: Column) -> DataFrame:
    """The last version of each key (an upsert of everything staged)."""
    rest = [c for c in raw.columns if c not in key]
    return raw.groupBy(*key).agg(F.max_by(F.struct(*rest), at).alias("h")).select(*key, "h.*")


def without_nul(payload: Column) -> Column:
    """A payload without NUL characters, escaped or not; an escaped backslash before u0000 is no escape of NUL."""
    clean = F.replace(payload, F.lit("\0"), F.lit(""))
    return F.when(F.contains(clean, F.lit(r"\u0000")), F.regexp_replace(clean, r"(?<!\\)((?:\\\\)*)\\u0000", "$1")).otherwise(clean)  # few have any to look for


def pruned(raw: DataFrame, fetched: DataFrame, key: Sequence[str], types: Sequence[str], unread: Sequence[str] = ()) -> DataFrame:
    """Staged objects that the forge no longer has: of the types that were read in full, those not among the fetched."""
    whole = [t for t in types if t not in unread]
    return raw.where(F.col("object_type").isin(*whole)).join(fetched.select(*key), list(key), "left_anti")


def change_set(stored: DataFrame, wanted: DataFrame, key: Sequence[str], same: Sequence[str]) -> DataFrame:
    """(key, action): insert, update, unchanged or delete. `same` are the columns whose equality means unchanged."""
    old = stored.select(*key, F.struct(*same).alias("_old"))
    new = wanted.select(*key, F.struct(*same).alias("_new"))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("update")
    return old.join(new, list(key), "full_outer").select(*key, action.alias("action"))


def superseded(stored: DataFrame, wanted: DataFrame, key: Sequence[str], text_hash: str) -> DataFrame:
    """The rows that go into the history: stored text that was edited or deleted, with the reason."""
    new = wanted.select(*key, F.col(text_hash).alias("_new"), F.lit(True).alias("_there"))
    rows = stored.join(new, list(key), "left")
    reason = F.when(F.col("_there").isNull(), "deleted").when(F.col(text_hash) != F.col("_new"), "edited")
    return rows.withColumn("reason", reason).where("reason is not null").drop("_new", "_there")


def changed_sets(stored: DataFrame, wanted: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys whose set of values differs; only these are written again. A set differs where one of its values is on one side only."""
    sides = stored.select(*key, *values, F.lit(True).alias("_old")).unionByName(wanted.select(*key, *values, F.lit(False).alias("_old")))
    one = sides.groupBy(*key, *values).agg(F.bool_or("_old").alias("_old"), F.bool_and("_old").alias("_only"))
    return one.where(F.col("_old") == F.col("_only")).select(*key).distinct()


def advanced(marks: DataFrame, seen: DataFrame, key: Sequence[str]) -> DataFrame:
    """High-water marks never go back."""
    new = seen.select(*key, F.col("high_water").alias("_seen"))
    return marks.join(new, list(key), "full_outer").withColumn("high_water", F.greatest("high_water", "_seen")).drop("_seen")


def sample_floor(floors: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """A sample only widens: the earlier floor stands."""
    other = new.select(*key, F.col("indexed_from").alias("_new"))
    return floors.join(other, list(key), "full_outer").withColumn("indexed_from", F.least("indexed_from", "_new")).drop("_new")
