"""Queries of the passes: resumed walks and their marks, samples, and who may write."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.plans import passes
from threadloom.plans.landing import Landing
from threadloom.plans.registry import query
from threadloom.plans.views import table, view
from threadloom.sources.store import shared_folder


@query(
    """s as (select repo, created_at as ts, 1 as walk, number % 997 <> 0 as ok from h_threads
union all select repo, created_at, 2, number % 4001 <> 0 from h_threads where created_at >= timestamp '1994-01-01' and created_at < timestamp '1997-01-01'),
e as (select min(ts) as a, max(ts) as b from s where walk = 2),
f as (select repo, ts from s, e where not ok and not (walk = 1 and ts between a and b)), o as (select repo, min(ts) as stop, count(*) as held from f group by 1)
select s.repo, max(case when ok and (stop is null or ts < stop) then ts end) as high_water, cast(coalesce(max(held), 0) as bigint) as held from s left join o using (repo) group by 1"""
)
def backfill_marks(spark: SparkSession, d: str) -> DataFrame:
    """Marks of a list that was walked twice, the second time over three years of it; failures that the second walk passed no longer hold them."""
    rows = view(spark, d, "h_threads").select("repo", F.col("created_at").alias("updated_at"), "number")
    again = rows.where("updated_at >= timestamp '1994-01-01' and updated_at < timestamp '1997-01-01'")
    staged = rows.withColumns({"walk": F.lit(1), "ok": F.expr("number % 997 <> 0")}).unionByName(again.withColumns({"walk": F.lit(2), "ok": F.expr("number % 4001 <> 0")}))
    return passes.marks(staged.drop("number"))


def _walked(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The conversations as landed walks: a thread each, a comment a turn. The second walk has every fifth thread again, with another body."""
    turns = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    n, repo = F.col("conv_id").cast("string"), F.concat(F.lit("org/r"), (F.col("conv_id") % 3).cast("string"))

    def landed(rows: DataFrame, walk: int, kind: str, oid, *fields) -> DataFrame:
        at = F.lit(f"2025-01-0{walk}T00:00:00Z")
        who = [F.struct(F.lit("ann").alias("login"), F.lit("User").alias("type")).alias("user"), F.lit("NONE").alias("author_association"), at.alias("created_at"), at.alias("updated_at")]
        text = F.to_json(F.struct(*fields, *who))
        return rows.select(
            repo.alias("repo"), F.lit(kind).alias("object_type"), oid.cast("string").alias("object_id"), F.lit(None).cast("long").alias("thread_number"), text.alias("payload"),
            at.cast("timestamp").alias("fetched_at"), at.cast("timestamp").alias("updated_at"), F.lit(walk).alias("walk"),
        )

    if name == "issue_comments":
        oid = F.col("conv_id") * 1000 + F.col("turn")
        body = F.concat(F.lit("note "), F.col("turn").cast("string"), F.lit(" by "), F.coalesce("role", F.lit("nobody")))
        return landed(turns, 1, "issue_comment", oid, oid.alias("id"), body.alias("body"), F.concat(F.lit("https://h/repos/"), repo, F.lit("/issues/"), n).alias("issue_url"))
    heads = turns.select("conv_id").distinct()
    head = lambda rows, walk: landed(rows, walk, "issue", n, F.col("conv_id").alias("number"), F.concat(F.lit("thread "), n).alias("title"), F.lit(f"body {walk}").alias("body"))
    return head(heads, 1).unionByName(head(heads.where("conv_id % 5 = 0"), 2))


@query(
    """with t as (select conv_id, turn, min(role) as role from conversations group by all), h as (select distinct conv_id from t)
select 'org/r' || cast(conv_id % 3 as varchar(20)) as repo, conv_id as number, 'title' as source_type, 'thread ' || cast(conv_id as varchar(20)) as body_text from h
union all select 'org/r' || cast(conv_id % 3 as varchar(20)), conv_id, 'body', case when conv_id % 5 = 0 then 'body 2' else 'body 1' end from h
union all select 'org/r' || cast(conv_id % 3 as varchar(20)), conv_id, 'issue_comment', 'note ' || cast(turn as varchar(20)) || ' by ' || coalesce(role, 'nobody') from t"""
)
def backfill_resumed(spark: SparkSession, d: str) -> DataFrame:
    """The documents of a first fill whose first run ended after one list was staged, and whose second found a second walk of it."""
    folder = f"{shared_folder(spark)}/backfills/{uuid.uuid4().hex}"
    fill = passes.Backfill(Landing(spark, f"{folder}/index", 8), f"{folder}/landed", files_per_batch=4)
    authority = spark.sql("select * from values ('org/r0', 'ann', 'write') as t(repo, login, permission)")
    heads = _walked(spark, d, "threads")
    heads.where("walk = 1").write.partitionBy("walk").json(f"{fill.landed}/threads")
    fill.walk("threads")
    heads.where("walk = 2").write.mode("append").partitionBy("walk").json(f"{fill.landed}/threads")
    _walked(spark, d, "issue_comments").write.partitionBy("walk").json(f"{fill.landed}/issue_comments")
    fill.run(authority, ("threads", "issue_comments"))
    return fill.landing.read("documents").select("repo", "number", "source_type", "body_text")


@query(
    """w as (select 'org/r0' as repo, 'issue' as thread_type, timestamp '1994-01-01' as walk_from, false as merged_only union all select 'org/r1', 'pr', timestamp '1993-01-01', true
union all select 'org/r2', 'issue', timestamp '1996-12-31 23:59:00', false union all select 'org/r3', 'pr', timestamp '1997-06-01', false)
select t.repo, t.number, t.thread_type, case when t.number % 4 = 0 then 'skip' else 'fetch' end as action from h_threads t join w using (repo, thread_type)
where t.created_at >= w.walk_from and (not merged_only or t.merged_at is not null)"""
)
def sample_actions(spark: SparkSession, d: str) -> DataFrame:
    """Four samples of a listing: one new, one that widens a recorded one, one that resumes, and one that is narrower than its mark."""
    rows = [("org/r0", "issue", "1994-01-01", False), ("org/r1", "pr", "1993-01-01", True), ("org/r2", "issue", "1995-01-01", False), ("org/r3", "pr", "1997-06-01", False)]
    asked = spark.createDataFrame(rows, "repo string, thread_type string, since string, merged_only boolean").withColumn("since", F.to_timestamp("since"))
    before = spark.createDataFrame([("org/r1", "pr", "1995-01-01"), ("org/r2", "issue", "1995-01-01"), ("org/r3", "pr", "1990-01-01")], "repo string, thread_type string, at string")
    floors = before.select("repo", "thread_type", F.to_timestamp("at").alias("indexed_from"))
    reached = spark.createDataFrame([("org/r1", "pr", "1998-01-01"), ("org/r2", "issue", "1997-01-01"), ("org/r3", "pr", "1996-01-01")], "repo string, thread_type string, at string")
    windows = passes.sample_windows(asked, floors, reached.select("repo", "thread_type", F.to_timestamp("at").alias("high_water")))
    listing = view(spark, d, "h_threads").withColumn("updated_at", F.col("created_at").cast("timestamp"))
    return passes.sample(windows, listing, listing.where("number % 4 = 0")).select("repo", "number", "thread_type", "action")


_MEMBERS = """m as (select distinct repo, h.author as login from h_documents h join h_threads t using (number)), b as (select distinct repo, author as login from h_threads where merged_at is not null and created_at < timestamp '1993-01-01'),
s as (select repo, login, cast(substr(login, 2) as int) as u, case cast(substr(login, 2) as int) % 4 when 0 then 'write' when 1 then 'read' end as old from m),
r as (select s.repo, s.login, old, u % 3 = 0 and u % 2 = 0 as fresh, case when u % 5 = 0 then 'admin' when u % 5 = 1 then 'none' when b.login is not null then 'write' end as told,
case when u % 5 <= 1 then 'permission_api' when b.login is not null then 'merged_by' else 'association' end as how, u % 3 = 0 as known from s left join b using (repo, login)),
v as (select repo, login, case when fresh then old else told end as permission, case when fresh then 'stored' else how end as source, case when known then old end as before from r)"""


@query(f"{_MEMBERS}\nselect repo, login, permission, source, before is distinct from permission as changed, coalesce(permission in ('admin', 'write'), false) and not coalesce(before in ('admin', 'write'), false) as promoted from v")
def authority_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Who may write: what is known and recent, else the forge's answer, else merges of their own."""
    return _resolved(spark, d).select("repo", "login", "permission", "source", "changed", "promoted")


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    heads = view(spark, d, "h_threads")
    members = view(spark, d, "h_documents").select("number", F.col("author").alias("login")).join(heads.select("repo", "number"), "number").select("repo", "login").distinct()
    u = F.substring("login", 2, 20).cast("int")
    known = members.where(u % 3 == 0).select("repo", "login", F.when(u % 4 == 0, "write").when(u % 4 == 1, "read").alias("permission"), F.to_timestamp(F.when(u % 2 == 0, "2025-03-20").otherwise("2025-01-01")).alias("checked_at"))
    answers = members.where(u % 5 <= 1).select("repo", "login", F.when(u % 5 == 0, "admin").otherwise("none").alias("permission"))
    merged = heads.where("merged_at is not null and created_at < timestamp '1993-01-01'").select("repo", F.col("author").alias("login"))
    return passes.resolved_authority(members, answers, merged, known, F.to_timestamp(F.lit("2025-04-01")))


@query(f"{_MEMBERS}\nselect distinct t.repo, h.number from h_documents h join h_threads t using (number) join v on v.repo = t.repo and v.login = h.author where before is distinct from permission")
def authority_threads(spark: SparkSession, d: str) -> DataFrame:
    """The threads to derive again after a look at who may write."""
    texts = view(spark, d, "h_documents").select("number", "author").join(view(spark, d, "h_threads").select("repo", "number"), "number")
    return passes.threads_to_derive(_resolved(spark, d), texts)
