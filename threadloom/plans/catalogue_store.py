"""Change-sets, pruning, marks, rates and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import evaluation
from threadloom.plans import derive, index
from threadloom.plans.registry import query
from threadloom.plans.views import dealt, table, view
from threadloom.schemas import RAW
from threadloom.sources import store
from threadloom.streaming import ingest, limits

_KEY = "number, chunk_index, source_id, l_suppkey, l_extendedprice, created_at"
_KEYS = _KEY.split(", ")
_OLD = f"o as (select {_KEY}, sha256(author || trust) as content_hash, trust from h_documents where l_suppkey % 11 <> 0)"
_NEW = f"n as (select {_KEY}, sha256(case when l_suppkey % 7 = 0 then 'edited' else author end || trust) as content_hash, case when l_suppkey % 13 = 0 then 'machine' else trust end as trust from h_documents where l_suppkey % 17 <> 0)"


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs, digest = view(spark, d, "h_documents"), lambda who: F.sha2(F.concat(who, F.col("trust")), 256)
    old = docs.where("l_suppkey % 11 <> 0").select(*_KEYS, digest(F.col("author")).alias("content_hash"), "trust")
    new = docs.where("l_suppkey % 17 <> 0").select(*_KEYS, digest(F.when(F.col("l_suppkey") % 7 == 0, "edited").otherwise(F.col("author"))).alias("content_hash"), F.when(F.col("l_suppkey") % 13 == 0, "machine").otherwise(F.col("trust")).alias("trust"))
    return old, new


@query(
    f"""{_OLD}, {_NEW},
j as (select coalesce(o.number, n.number) as number, o.content_hash as oh, n.content_hash as nh, o.trust as ot, n.trust as nt from o full join n on o.number = n.number and o.chunk_index = n.chunk_index and o.source_id = n.source_id and o.l_suppkey = n.l_suppkey
  and o.l_extendedprice = n.l_extendedprice and o.created_at = n.created_at),
a as (select number, case when oh is null then 'insert' when nh is null then 'delete' when oh = nh and ot = nt then 'unchanged' else 'update' end as action from j)
select number, action, count(*) as n from a group by all"""
)
def reconcile_changeset(spark: SparkSession, d: str) -> DataFrame:
    old, new = _two(spark, d)
    return store.change_set(old, new, _KEYS, ["content_hash", "trust"]).groupBy("number", "action").agg(F.count("*").alias("n"))


@query(
    f"""{_OLD}, {_NEW},
j as (select o.*, n.content_hash as nh from o left join n using ({_KEY}))
select number, chunk_index, source_id, l_suppkey, case when nh is null then 'deleted' else 'edited' end as reason from j where nh is null or nh <> content_hash"""
)
def history_rows(spark: SparkSession, d: str) -> DataFrame:
    old, new = _two(spark, d)
    return store.superseded(old, new, _KEYS, "content_hash").select("number", "chunk_index", "source_id", "l_suppkey", "reason")


@query(
    """o as (select distinct number, path from h_files where source = 'changed' or number % 3 > 0), n as (select distinct number, path from h_files),
a as (select number, string_agg(path, ',' order by path) as p from o group by 1), b as (select number, string_agg(path, ',' order by path) as p from n group by 1)
select coalesce(a.number, b.number) as number from a full join b on a.number = b.number where a.p is distinct from b.p"""
)
def signal_reconcile(spark: SparkSession, d: str) -> DataFrame:
    files = dealt(spark, d, "h_files")
    return store.changed_sets(files.where("source = 'changed' or number % 3 > 0"), files, ["number"], ["path"])


@query(
    """r as (select number, source_id as object_id, source_type as object_type from h_documents)
select distinct number, object_type, object_id from r where object_type in ('issue_comment', 'review_comment') and object_id % 9 = 0"""
)
def prune_anti(spark: SparkSession, d: str) -> DataFrame:
    raw = view(spark, d, "h_documents").select("number", F.col("source_type").alias("object_type"), F.col("source_id").alias("object_id")).distinct()
    fetched = raw.where("object_id % 9 <> 0")
    return store.pruned(raw, fetched, ["number", "object_type", "object_id"], ["issue_comment", "review", "review_comment"], unread=["review"])


@query("select distinct number from h_documents where source_type in ('issue_comment', 'review', 'review_comment') and source_id % 31 = 0")
def sweep_anti(spark: SparkSession, d: str) -> DataFrame:
    """Threads to derive again after staged comments that no longer live are dropped."""
    staged = filters_comments(view(spark, d, "h_documents")).select("number", "source_type", "source_id").distinct()
    live = staged.where("source_id % 31 <> 0")
    return staged.join(live, ["number", "source_type", "source_id"], "left_anti").select("number").distinct()


def filters_comments(documents: DataFrame) -> DataFrame:
    return documents.where(~F.col("source_type").isin("title", "body"))


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events) where n = 1")
def raw_latest(spark: SparkSession, d: str) -> DataFrame:
    return store.latest(table(spark, d, "events"), ["user_id", "event_type"], F.struct("ts", "event_id")).select("user_id", "event_type", "event_id", "value")


@query(
    """with f as (select user_id, min(ts) filter (event_type = 'error') as stop, count(*) filter (event_type = 'error') as held from events group by 1)
select user_id, strftime(max(ts) filter (event_type <> 'error' and (stop is null or ts < stop)), '%Y-%m-%d %H:%M:%S') as high_water, any_value(held) as held from events join f using (user_id) group by 1"""
)
def high_water_stop_at_failure(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "events").withColumn("ok", F.col("event_type") != "error")
    return ingest.committed_mark(results, ["user_id"]).withColumn("high_water", F.date_format("high_water", "yyyy-MM-dd HH:mm:ss"))


@query("select event_id, commented from (select event_id, event_type = 'click' as commented, event_id % 4 = 0 as stored from events) where commented or not stored")
def skip_current(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    found = events.select("event_id", "ts", (F.col("event_type") == "click").alias("commented"))
    return ingest.skip_current(found, events.where("event_id % 4 = 0"), ["event_id"]).select("event_id", "commented")


@query(
    """with e as (select event_id, user_id, epoch_us(ts) as us from events)
select event_id, user_id, count(*) over (partition by user_id order by us range between 59999999 preceding and current row) as in_minute,
count(*) over (partition by user_id order by us range between 59999999 preceding and current row) <= 1 as allowed from e"""
)
def rate_limit_sliding(spark: SparkSession, d: str) -> DataFrame:
    return ingest.over_rate(table(spark, d, "events"), per_minute=1).select("event_id", "user_id", "in_minute", "allowed")


@query("select user_id, strftime(ts, '%Y-%m-%d') as day, count(*) as calls, count(*) <= 3 as allowed from events group by 1, 2")
def quota_daily(spark: SparkSession, d: str) -> DataFrame:
    return ingest.daily_quota(table(spark, d, "events"), per_day=3).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("select event_type, user_id, count(*) as events, round(sum(value), 2) as total from events group by 1, 2")
def stream_dedup_watermark(spark: SparkSession, d: str) -> DataFrame:
    """A file stream, deduplicated within a watermark, run until it has read everything, counted as a table."""
    stream = _event_stream(spark, d)
    folder = f"{store.shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    once = ingest.deduplicated(stream, ["event_id"], late="1 day")
    run = once.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("event_type", "user_id").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total"))


@query(
    """with e as (select event_id, user_id, epoch_us(ts) as us from events)
select user_id, event_id as call, coalesce(lag(us, 2) over (partition by user_id order by us, event_id) <= us - 60000000, true) as in_rate, row_number() over (partition by user_id, us // 86400000000 order by us, event_id) as of_day,
  row_number() over (partition by user_id, us // 86400000000 order by us, event_id) <= 3 as in_quota from e"""
)
def stream_limits(spark: SparkSession, d: str) -> DataFrame:
    """Rate and quota of each call as state of a stream, run until it has read everything."""
    folder, provider = f"{store.shared_folder(spark)}/streams/{uuid.uuid4().hex}", "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    limits.with_rocksdb(spark)
    try:
        found = limits.limited(_event_stream(spark, d), per_minute=2, per_day=3)
        found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(f"{folder}/out")


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    stream = spark.readStream.schema(table(spark, d, "events").schema)
    return stream.option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet") if _is_folder(spark, d) else stream.option("pathGlobFilter", "events.parquet").parquet(d)


def _is_folder(spark: SparkSession, d: str) -> bool:
    return not table(spark, d, "events").inputFiles()[0].rstrip("/").endswith("/events.parquet")


@query("select user_id, strftime(least(min(ts), timestamp '2024-01-03'), '%Y-%m-%d %H:%M:%S') as indexed_from from events group by 1")
def index_sample_floor(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    floors = events.select("user_id").distinct().withColumn("indexed_from", F.lit("2024-01-03").cast("timestamp"))
    new = events.groupBy("user_id").agg(F.min("ts").alias("indexed_from"))
    return store.sample_floor(floors, new, ["user_id"]).withColumn("indexed_from", F.date_format("indexed_from", "yyyy-MM-dd HH:mm:ss"))


_LINE = """json_object('author', author, 'chunk_index', chunk_index, 'number', number, 'repo', 'org/r', 'source_id', source_id, 'source_type', source_type, 'trust', trust)"""


def _exported(spark: SparkSession, d: str) -> DataFrame:
    docs = view(spark, d, "h_documents").select("number", "source_type", "source_id", "chunk_index", "author", "trust", F.lit("org/r").alias("repo"))
    return evaluation.corpus_lines(docs)


@query(f"select cast({_LINE} as varchar) as value from h_documents")
def corpus_export_rows(spark: SparkSession, d: str) -> DataFrame:
    return _exported(spark, d).select("value")


@query(
    f"""l as (select sha256(cast({_LINE} as varchar)) as h from h_documents),
s as (select count(*) as n, """
    + ", ".join(f"sum(cast(cast('0x' || substr(h, {1 + 16 * i}, 15) as bigint) as hugeint)) as s{i}" for i in range(4))
    + """ from l)
select n as rows, sha256(concat_ws(':', cast(n as varchar), cast(s0 as varchar), cast(s1 as varchar), cast(s2 as varchar), cast(s3 as varchar))) as digest from s"""
)
def export_digest(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.corpus_digest(_exported(spark, d).repartition(7))


@query("select user_id, min(event_id) as event_id, bool_or(event_type = 'click') as commented from events group by 1")
def poll_candidates(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", F.col("event_id").alias("ts"), "event_type")
    both = ingest.candidates(events, events.where("event_type = 'click'"), ["user_id"])
    return both.select("user_id", F.col("ts").alias("event_id"), "commented")


def landed_batch(spark: SparkSession, d: str, batch: int) -> DataFrame:
    """Payloads of the orders as threads and their lines as comments. The second batch has every fifth thread again, with
    another body and without the comments of even lines."""
    at = F.lit(f"2025-01-0{batch}T00:00:00Z")
    who = [F.struct(F.lit("ann").alias("login"), F.lit("User").alias("type")).alias("user"), F.lit("NONE").alias("author_association"), at.alias("created_at"), at.alias("updated_at")]
    n = F.col("number").cast("string")
    heads = table(spark, d, "orders").select(F.col("o_orderkey").alias("number"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("number"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("int").alias("quantity"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long") * 10_000_000 + F.col("l_partkey") * 100 + F.col("l_quantity").cast("int")).alias("id"))
    if batch == 2:
        heads, lines = heads.where("number % 5 = 0"), lines.where("number % 5 = 0 and line % 2 = 1")
    thread = F.struct("number", F.concat(F.lit("thread "), n).alias("title"), F.lit(f"body {batch}").alias("body"), *who)
    comment = F.struct("id", F.concat(F.lit("note "), F.col("quantity").cast("string")).alias("body"), F.concat(F.lit("https://h/repos/org/r/issues/"), n).alias("issue_url"), *who)
    rows = heads.select(F.lit("issue").alias("object_type"), n.alias("object_id"), F.to_json(thread).alias("payload"))
    rows = rows.unionByName(lines.select(F.lit("issue_comment").alias("object_type"), F.col("id").cast("string").alias("object_id"), F.to_json(comment).alias("payload")))
    return rows.select(F.lit("org/r").alias("repo"), "object_type", "object_id", F.lit(None).cast("long").alias("thread_number"), "payload", at.cast("timestamp").alias("fetched_at"), at.cast("timestamp").alias("updated_at"))


@query(
    """select o_orderkey as number, 'title' as source_type, o_orderkey as source_id, 'thread ' || cast(o_orderkey as varchar(20)) as body_text from orders
union all select o_orderkey, 'body', o_orderkey, case when o_orderkey % 5 = 0 then 'body 2' else 'body 1' end from orders
union all select distinct l_orderkey, 'issue_comment', cast(l_orderkey * 10 + l_linenumber as bigint) * 10000000 + l_partkey * 100 + cast(trunc(l_quantity) as int), 'note ' || cast(cast(trunc(l_quantity) as int) as varchar(20)) from lineitem where l_orderkey % 5 <> 0 or l_linenumber % 2 = 1"""
)
def ingest_two_batches(spark: SparkSession, d: str) -> DataFrame:
    """The documents after two batches, the second of which edits some threads and lost some of their comments."""
    none = store.nothing(spark, RAW)
    authority = spark.createDataFrame([("org/r", "ann", "write")], "repo string, login string, permission string")
    marks = spark.createDataFrame([], "repo string, high_water timestamp")
    folder = f"{store.shared_folder(spark)}/batches/{uuid.uuid4().hex}"

    def written(batch: str):
        def stage(rows: DataFrame, name: str) -> DataFrame:
            rows.write.parquet(f"{folder}/{batch}/{name}")
            return spark.read.schema(rows.schema).parquet(f"{folder}/{batch}/{name}")

        return stage

    first = index.indexed(none, landed_batch(spark, d, 1), derive.documents(derive.sources(none), authority), authority, marks, stage=written("on-the-way-1"))
    # all that the first batch left is in the files that it was staged in
    second = index.indexed(first.staged, landed_batch(spark, d, 2), first.documents, authority, written("left")(first.marks, "marks"), stage=written("on-the-way-2"))
    return second.documents.select("number", "source_type", "source_id", "body_text")
