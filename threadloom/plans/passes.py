"""Passes over the lists of a forge: the resumable first fill, samples, and who may write.

A fetcher lands what a list gives as JSON lines under `<landed>/<pass>/walk=<n>/`, in ascending order of updated_at. A walk that reaches the
row cap of its list goes on with a slice from its last time on, so slices overlap and objects come twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from threadloom.operators.filters import KEY
from threadloom.operators.lookups import threads_by
from threadloom.plans.landing import Landing
from threadloom.schemas import RAW
from threadloom.sources import store
from threadloom.streaming import ingest

#: The lists that are walked, in the order in which they are.
PASSES = ("threads", "issue_comments", "review_comments")
OBJECT = ("repo", "object_type", "object_id")
WRITERS = ("admin", "maintain", "write")
REFRESH_DAYS = 30
_LANDED = StructType([*RAW, StructField("walk", IntegerType())])
_CURSOR = "pass string, batch long"


def readable(rows: DataFrame) -> Column:
    """Whether a landed row can be indexed: it says what it is, when it changed, and its payload is JSON."""
    known = reduce(Column.__and__, (F.col(c).isNotNull() for c in (*OBJECT, "updated_at") if c in rows.columns))
    return known & F.try_parse_json("payload").isNotNull()


def marks(staged: DataFrame) -> DataFrame:
    """(repo, high_water, held): how far each repository's list has been read without a gap, and how many failures stand.

    staged: (repo, updated_at, walk, ok). A failure stands until a later walk has read past its time. The mark is the last readable row before the
    first standing failure, null where there is none. A failed row without a time counts as the first of its walk, one without a repository
    holds all of them. The walks go through one row with an entry a walk, of which there are as many as runs.
    """
    span = staged.groupBy("walk").agg(F.min("updated_at").alias("start"), F.max("updated_at").alias("end"))
    walks = span.agg(F.collect_list(F.struct("walk", "start", "end")).alias("walks"))
    failed = staged.where(~F.col("ok")).select("repo", "walk", "updated_at").join(span.select("walk", "start"), "walk")
    failed = failed.select("repo", "walk", F.coalesce("updated_at", "start", F.lit("0001-01-01").cast("timestamp")).alias("ts")).join(walks)
    again = F.exists("walks", lambda w: (w["walk"] > F.col("walk")) & (w["start"] <= F.col("ts")) & (w["end"] >= F.col("ts")))
    standing = failed.where(~F.coalesce(again, F.lit(False)))
    own = standing.where("repo is not null").groupBy("repo").agg(F.min("ts").alias("stop"), F.count("*").alias("held"))
    nobody = standing.where("repo is null").agg(F.min("ts").alias("stop_all"), F.count("*").alias("held_all"))
    before = F.col("updated_at") < F.least("stop", "stop_all")
    rows = staged.where("repo is not null").join(own, "repo", "left").join(nobody)
    reached = F.max(F.when(F.col("ok") & F.coalesce(before, F.lit(True)), F.col("updated_at")))
    return rows.groupBy("repo").agg(reached.alias("high_water"), (F.coalesce(F.max("held"), F.lit(0)) + F.max("held_all")).alias("held"))


@dataclass(frozen=True)
class Backfill:
    """Fills an index from landed walks; a run that dies is started again and gives what one run gives.

    Each list is a stream with a checkpoint of its own. A micro-batch admits `files_per_batch` files and is staged in a folder of its number, which a
    second attempt overwrites, so no row is staged twice or lost. The index is derived from the batches after a cursor that moves when they
    are in; indexing a batch again changes nothing.
    """

    landing: Landing
    landed: str
    files_per_batch: int = 100

    @property
    def _path(self) -> str:
        return f"{self.landing.path.rstrip('/')}/passes"

    def stage(self, batch: DataFrame, name: str, number: int) -> None:
        rows = batch.withColumn("payload", store.without_nul(F.col("payload")))
        rows.withColumn("ok", readable(rows)).write.mode("overwrite").parquet(f"{self._path}/{name}/batch={number}")

    def walk(self, name: str) -> None:
        """Stage what has landed for a list since the last run, batch after batch."""
        stream = self.landing.spark.readStream.schema(_LANDED).option("maxFilesPerTrigger", self.files_per_batch).json(f"{self.landed.rstrip('/')}/{name}")
        ingest.ingest(stream, f"{self._path}/checkpoints/{name}", lambda batch, number: self.stage(batch, name, number), once=True).awaitTermination()

    def _read(self, name: str, schema: StructType) -> DataFrame:
        spark, path = self.landing.spark, f"{self._path}/{name}"
        try:
            return spark.read.schema(schema).parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return store.nothing(spark, schema)
            raise

    def staged(self, name: str) -> DataFrame:
        """Every row of a list that was staged, with its batch and walk, and whether it is readable."""
        return self._read(name, StructType([*_LANDED]).add("ok", "boolean").add("batch", "long")).withColumn("pass", F.lit(name))

    def cursors(self) -> dict[str, int]:
        rows = self._read("cursors", StructType().add("pass", "string").add("batch", "long")).groupBy("pass").agg(F.max("batch").alias("batch"))
        return {r["pass"]: r["batch"] for r in rows.collect()}  # a row a list

    def marks(self, name: str) -> DataFrame:
        return marks(self.staged(name))

    def index(self, authority: DataFrame, names: Sequence[str] = PASSES) -> dict[str, int]:
        """Derive the threads of all batches after the cursors. Returns document rows by action; nothing where there is no new batch.

        A slice of a list is never all that a thread has, so nothing is pruned.
        """
        done = self.cursors()
        parts = [self.staged(n).where(F.col("batch") > done.get(n, -1)) for n in names]
        new = reduce(DataFrame.unionByName, parts)
        reached = new.groupBy("pass").agg(F.max("batch").alias("batch")).collect()  # a row a list
        if not reached:
            return {}
        last = store.latest(new.where("ok").select(RAW.names), OBJECT, F.struct("updated_at", "fetched_at")).select(RAW.names)
        actions = self.landing.apply(last, authority, whole=())
        self.landing.spark.createDataFrame([tuple(r) for r in reached], _CURSOR).coalesce(1).write.mode("append").parquet(f"{self._path}/cursors")
        return actions

    def run(self, authority: DataFrame, names: Sequence[str] = PASSES) -> dict[str, int]:
        for name in names:
            self.walk(name)
        return self.index(authority, names)


# -- samples -----------------------------------------------------------------------------------------------------------


def sample_windows(requests: DataFrame, floors: DataFrame, high_waters: DataFrame) -> DataFrame:
    """requests (repo, thread_type, since, ...) with the recorded floor, whether they widen it, and where their walk begins.

    A mark says how far a walk came within its window. For an earlier window it says nothing, so a widening request ignores it;
    others go on a little before it.
    """
    key = ["repo", "thread_type"]
    rows = requests.join(floors.select(*key, F.col("indexed_from").alias("floor")), key, "left").join(high_waters.select(*key, "high_water"), key, "left")
    widens = F.coalesce(F.col("since") < F.col("floor"), F.lit(False))
    start = F.when(widens | F.col("high_water").isNull(), F.col("since")).otherwise(F.greatest("since", ingest.window_start(F.col("high_water"))))
    return rows.withColumn("widens", widens).withColumn("walk_from", start)


def sample(windows: DataFrame, listing: DataFrame, known: DataFrame) -> DataFrame:
    """(repo, number, thread_type, updated_at, action): what a sample takes from a listing; `skip` where the stored copy has the listing's time, else `fetch`.

    listing: (repo, number, thread_type, updated_at, merged_at). Requests may ask for merged threads only (merged_only). One that has `most` asks for the
    first so many of its walk; null means all.
    """
    rows = listing.join(windows, ["repo", "thread_type"]).where("updated_at >= walk_from and (not merged_only or merged_at is not null)")
    if "most" in windows.columns:
        place = F.row_number().over(Window.partitionBy("repo", "thread_type").orderBy("updated_at", "number"))
        rows = rows.withColumn("place", place).where("most is null or place <= most")
    held = known.select(*KEY, "updated_at").distinct().withColumn("held", F.lit(True))
    action = F.when(F.coalesce("held", F.lit(False)), "skip").otherwise("fetch")
    return rows.join(held, [*KEY, "updated_at"], "left").select(*KEY, "thread_type", "updated_at", action.alias("action"))


def selector(since: Column, merged_only: Column, most: Column) -> Column:
    """How a sample was chosen, so that it can be chosen again."""
    first = F.concat(F.lit("updated>="), F.date_format(since, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return F.concat_ws(", ", first, F.when(merged_only, "merged only"), F.concat(F.lit("limit "), most.cast("string")))


# -- who may write -----------------------------------------------------------------------------------------------------


def resolved_authority(members: DataFrame, answers: DataFrame, merged_by: DataFrame, stored: DataFrame, now: Column, days: int = REFRESH_DAYS) -> DataFrame:
    """(repo, login, permission, source, before, looked_up, changed, promoted) of every member whose right to write matters.

    members (repo, login); answers (repo, login, permission), `none` for those that the forge doesn't know; merged_by (repo, login); stored (repo, login,
    permission, checked_at). What was looked up less than `days` ago stands. Else the forge's answer counts, then a merge, which only those who may
    write can do, and otherwise nothing is granted: a maintainer taken for a stranger costs less than the reverse.
    """
    key = ["repo", "login"]
    rows = members.select(*key).distinct().join(stored.select(*key, F.col("permission").alias("before"), "checked_at"), key, "left")
    rows = rows.join(answers.select(*key, F.col("permission").alias("answer")), key, "left").join(merged_by.select(*key).distinct().withColumn("merged", F.lit(True)), key, "left")
    fresh = F.coalesce(F.col("checked_at") > now - F.expr(f"interval {days} days"), F.lit(False))
    told = F.when(F.col("answer").isNotNull(), F.col("answer")).when(F.col("merged"), "write")
    source = F.when(fresh, "stored").when(F.col("answer").isNotNull(), "permission_api").when(F.col("merged"), "merged_by").otherwise("association")
    rows = rows.withColumn("permission", F.when(fresh, F.col("before")).otherwise(told)).withColumn("source", source).withColumn("looked_up", ~fresh)
    may = lambda c: F.coalesce(F.col(c).isin(*WRITERS), F.lit(False))
    rows = rows.withColumn("changed", ~F.col("permission").eqNullSafe(F.col("before"))).withColumn("promoted", may("permission") & ~may("before"))
    return rows.select(*key, "permission", "source", "before", "looked_up", "changed", "promoted")


def threads_to_derive(resolved: DataFrame, documents: DataFrame) -> DataFrame:
    """The threads whose texts may change their trust: those with a text by somebody whose permission changed."""
    return threads_by(documents, resolved.where("changed").select("repo", "login"))
