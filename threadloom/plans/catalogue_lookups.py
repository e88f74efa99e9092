"""Lookups, as-of pins, evaluation tables and the words of a question."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import error_norm
from threadloom.operators import asof, datasets, lookups
from threadloom.plans.registry import query
from threadloom.plans.views import dealt, in_repo, table, view
from threadloom.sources.store import shared_folder


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "h_documents").select(F.lit("org/r").alias("repo"), "number", F.col("source_type").alias("object_type"), F.col("source_id").alias("object_id"))


@query("select distinct number from h_documents where number > 500")
def staged_numbers(spark: SparkSession, d: str) -> DataFrame:
    return lookups.staged_numbers(_raw(spark, d), 500).select("number")


@query("select distinct number from h_documents where source_type = 'review' and source_id % 7 = 0")
def threads_of_objects(spark: SparkSession, d: str) -> DataFrame:
    raw = _raw(spark, d)
    return lookups.threads_of_objects(raw, raw.where("object_type = 'review' and object_id % 7 = 0").select("object_type", "object_id").distinct()).select("number")


@query("select distinct number from h_documents where number not in (select number from h_threads where number % 4 <> 0)")
def orphan_numbers(spark: SparkSession, d: str) -> DataFrame:
    heads = view(spark, d, "h_threads").where("number % 4 <> 0").select(F.lit("org/r").alias("repo"), "number")
    return lookups.orphans(_raw(spark, d), heads).select("number")


@query("select distinct repo, author as login from h_threads where merged_at is not null and author <> 'u3'")
def merger_logins(spark: SparkSession, d: str) -> DataFrame:
    return lookups.mergers(view(spark, d, "h_threads"), F.when(F.col("author") != "u3", F.col("author")))


@query("select distinct repo, d.author from h_documents d join h_threads t using (number) where l_suppkey % 3 = 1 and trust <> 'machine'")
def member_logins(spark: SparkSession, d: str) -> DataFrame:
    docs = in_repo(spark, d, "h_documents").withColumns({"association": F.when(F.col("l_suppkey") % 3 == 1, "MEMBER").otherwise("NONE"), "author_is_bot": F.col("trust") == "machine"})
    return lookups.member_authors(docs)


@query("select distinct repo, number from h_documents d join h_threads t using (number) where (repo = 'org/r1' and d.author = 'u5') or (repo = 'org/r2' and d.author in ('u5', 'u9'))")
def threads_by_logins(spark: SparkSession, d: str) -> DataFrame:
    logins = spark.createDataFrame([("org/r1", "u5"), ("org/r2", "u5"), ("org/r2", "u9")], "repo string, login string")
    return lookups.threads_by(in_repo(spark, d, "h_documents"), logins)


@query("select distinct repo from h_threads")
def indexed_repos(spark: SparkSession, d: str) -> DataFrame:
    return lookups.indexed_repos(view(spark, d, "h_threads"))


@query("select repo, path, string_agg(distinct number, ',' order by number) as numbers from h_files join h_threads using (number) group by all")
def paths_to_threads(spark: SparkSession, d: str) -> DataFrame:
    return lookups.paths_to_threads(in_repo(spark, d, "h_files")).withColumn("numbers", F.array_join("numbers", ","))


@query("select number, 'ValueError: ' || min(lower(regexp_replace(replace(body, 'ValueError: ', ''), '[0-9]+', '<n>', 'g'))) as error from h_error_text group by 1")
def thread_error(spark: SparkSession, d: str) -> DataFrame:
    errors = view(spark, d, "h_error_text").select(F.lit("org/r").alias("repo"), "number", F.lit("ValueError").alias("exception_type"), error_norm(F.regexp_extract("body", r"ValueError: (.*)", 1)).alias("message_norm"))
    return lookups.first_errors(errors).select("number", "error")


@query(
    """w as (select number, source_id from (select distinct number, source_id from h_documents where source_id % 3 = 0) union select number, -1 from h_threads where number % 10 = 1),
s as (select number, source_id, max(case when trust <> 'machine' then 1 else 0 end) as human, string_agg(case when trust <> 'machine' then author end, chr(10) order by chunk_index, author) as body
  from h_documents where source_type not in ('title', 'body') group by 1, 2)
select w.number, w.source_id, case when human is null then 'absent' when human = 1 then 'served' else 'suppressed' end as status, body from w left join s using (number, source_id)"""
)
def one_comment(spark: SparkSession, d: str) -> DataFrame:
    docs = view(spark, d, "h_documents").withColumns({"repo": F.lit("org/r"), "body_text": F.col("author")})
    some = docs.where("source_id % 3 = 0").select("repo", "number", "source_id")
    wanted = some.unionByName(view(spark, d, "h_threads").where("number % 10 = 1").select(F.lit("org/r").alias("repo"), "number", F.lit(-1).cast(docs.schema["source_id"].dataType).alias("source_id")))
    return lookups.one_comment(docs, wanted.distinct()).select("number", "source_id", "status", "body")


@query("select number from h_threads where created_at < timestamp '1997-06-01' and number not in (7, 33, 3, 1)")
def as_of_reachable(spark: SparkSession, d: str) -> DataFrame:
    pin = lookups.AsOf(datetime(1998, 1, 1, tzinfo=UTC), (7, 33)).narrowed(datetime(1997, 6, 1, tzinfo=UTC), (3, 7, 1))
    return pin.narrowed(datetime(1999, 1, 1, tzinfo=UTC)).reachable(view(spark, d, "h_threads")).select("number")


# -- as of a time: posts of which some were edited or deleted later ---------------------------------------------------------

_POSTS = """p as (select number, comment, timestamp '2020-01-01' + to_days(cast(number % 90 + comment as integer)) as created_at, body from h_posts),
v as (
  select number, comment, created_at, case when comment % 3 = 1 then body || ' now `edited_' || cast(number % 9 as varchar) || '.later()`' else body end as body, case when comment % 3 = 1 then created_at + interval 20 day else created_at end as f, null as t from p where comment % 5 <> 4
  union all select number, comment, created_at, body, created_at, created_at + interval 20 day from p where comment % 3 = 1 and comment % 5 <> 4
  union all select number, comment, created_at, body, created_at, created_at + interval 15 day from p where comment % 5 = 4),
c as (select unnest([timestamp '2020-01-20', timestamp '2020-02-25']) as cutoff),
s as (select cutoff, v.* from v, c where f < cutoff and created_at < cutoff and (t is null or t >= cutoff))"""
CUTOFFS = (datetime(2020, 1, 20, tzinfo=UTC), datetime(2020, 2, 25, tzinfo=UTC))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    posts = view(spark, d, "h_posts").select("number", "comment", F.lit("2020-01-01").cast("timestamp") + F.make_dt_interval((F.col("number") % 90 + F.col("comment")).cast("int")), "body").toDF("number", "comment", "created_at", "body")
    edited, gone = F.col("comment") % 3 == 1, F.col("comment") % 5 == 4
    later = F.concat("body", F.lit(" now `edited_"), (F.col("number") % 9).cast("string"), F.lit(".later()`"))
    old = posts.where(edited | gone).withColumn("superseded_at", F.col("created_at") + F.when(gone, F.expr("interval 15 days")).otherwise(F.expr("interval 20 days")))
    return asof.versions(posts.where(~gone).withColumn("body", F.when(edited, later).otherwise(F.col("body"))), old, ["number", "comment"])


@query(_POSTS + " select strftime(cutoff, '%Y-%m-%d') as cutoff, number, comment, sha256(body) as digest from s")
def as_of_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each text as it stood at two cutoffs: edits after them do not show, texts deleted after them do."""
    rows = _versions(spark, d)
    stood = [rows.where(asof.stood_at(F.lit(t)) & (F.col("created_at") < F.lit(t))).withColumn("cutoff", F.lit(t.strftime("%Y-%m-%d"))) for t in CUTOFFS]
    return stood[0].unionByName(stood[1]).select("cutoff", "number", "comment", F.sha2("body", 256).alias("digest"))


@query(
    _POSTS
    + r""", x as (select cutoff, number, unnest(regexp_extract_all(body, '`([^`\n]+)`', 1)) as span from s), g as (select cutoff, number, regexp_replace(span, '\(\)$', '') as symbol, case when ends_with(span, '()') then 'call' end as symbol_type from x)
select strftime(cutoff, '%Y-%m-%d') as cutoff, number, symbol, max(symbol_type) as symbol_type from g group by all"""
)
def as_of_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The symbols that each thread had shown by two cutoffs, read again from the texts of the time."""
    rows, out = _versions(spark, d), []
    for t in CUTOFFS:
        stood = rows.where(asof.stood_at(F.lit(t)) & (F.col("created_at") < F.lit(t))).withColumn("chunk_index", F.lit(0))
        texts = asof.rejoined_texts(stood, ["number", "comment"], "body")
        heads = stood.select("number", F.lit(None).cast("timestamp").alias("merged_at")).distinct()
        found = asof.signals_at(texts, heads, view(spark, d, "h_files"), t, ["number"])["symbols"]
        out.append(found.select(F.lit(t.strftime("%Y-%m-%d")).alias("cutoff"), "number", "symbol", "symbol_type"))
    return out[0].unionByName(out[1])


@query(
    """c as (select unnest([timestamp '1995-06-01', timestamp '1998-03-01']) as cutoff)
select strftime(cutoff, '%Y-%m-%d') as cutoff, number, case when merged_at < cutoff then state else 'open' end as state, merged_at < cutoff and merged_at is not null as merged from h_threads, c where created_at < cutoff"""
)
def as_of_threads(spark: SparkSession, d: str) -> DataFrame:
    """Threads as they were: what was merged later is still open."""
    out = [asof.threads_at(view(spark, d, "h_threads"), t).withColumn("cutoff", F.lit(t.strftime("%Y-%m-%d"))) for t in (datetime(1995, 6, 1, tzinfo=UTC), datetime(1998, 3, 1, tzinfo=UTC))]
    return out[0].unionByName(out[1]).select("cutoff", "number", "state", F.col("merged_at").isNotNull().alias("merged"))


@query("select distinct repo, number from h_threads where thread_type = 'pr' and (merged_at is not null or state = 'open') and number % 3 <> 1")
def pulls_to_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Merged and open pull requests whose details are not staged yet."""
    heads = view(spark, d, "h_threads")
    wanted = heads.where("thread_type = 'pr' and (merged_at is not null or state = 'open')").select("repo", "number").distinct()
    return lookups.without_staged(wanted, heads.where("number % 3 = 1"))


@query(
    """with r as (select user_id as question, event_type as item, row_number() over (partition by user_id order by ts, event_id) as position from events),
f as (select question, item, min(position) as first from r group by 1, 2)
select question, item, row_number() over (partition by question order by first, item) as rank from f"""
)
def first_positions(spark: SparkSession, d: str) -> DataFrame:
    from threadloom.operators.evaluation import ranked

    rows = ranked(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")])
    return lookups.first_positions(rows.select(F.col("user_id").alias("question"), F.col("event_type").alias("item"), F.col("rank").alias("position"))).withColumn("rank", F.col("rank").cast("long"))


@query(
    """with c as (select doc_id as id, quality + toxic as score, doc_id % 40 as asked, case when doc_id % 2 = 0 then 'failure' else 'rationale' end as kind from labels),
o as (select *, row_number() over (partition by kind, asked order by score desc, id) as n from c), b as (select *, row_number() over (partition by kind order by score desc, id) as m from o where n = 1)
select id, kind, asked, score from b where m <= 8"""
)
def mined_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") + F.col("toxic")).alias("score"), (F.col("doc_id") % 40).alias("asked"), F.when(F.col("doc_id") % 2 == 0, "failure").otherwise("rationale").alias("kind"))
    return lookups.best_candidates(rows, ["kind", "asked"], 8)


@query("select case when quality = 1 then 'good' else 'bad' end as kind, count(*) filter (toxic = 0) as clean, count(*) filter (toxic = 1) as toxic from labels group by 1")
def slice_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("kind"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("slice"))
    return lookups.slice_counts(rows, "slice", ["clean", "toxic"])


@query(
    """with c as (select user_id, event_type, event_type = 'error' as refused, event_id % 1000 as chars, event_id % 20 + 1 as lines, event_id % 7 % (event_id % 20 + 1) as new_lines, event_type = 'purchase' as hit, row_number() over (partition by user_id order by ts, event_id) as position from events)
select user_id, count(*) as calls, count(*) filter (refused) as refused, cast(coalesce(sum(chars) filter (not refused), 0) as bigint) as chars_total, median(chars) filter (not refused) as chars_median, max(chars) filter (not refused) as chars_max,
min(position) filter (hit) as time_to_evidence, round(1 - cast(sum(new_lines) filter (not refused) as double) / nullif(sum(lines) filter (not refused), 0), 3) as repeat_share, count(*) - count(distinct event_type) as rerolls from c group by 1"""
)
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    from threadloom.operators.evaluation import ranked

    e = F.col("event_id")
    calls = ranked(table(spark, d, "events"), ["user_id"], [F.col("ts"), e]).withColumns({
        "refused": F.col("event_type") == "error", "chars": e % 1000, "lines": e % 20 + 1, "new_lines": e % 7 % (e % 20 + 1), "reached_evidence": F.col("event_type") == "purchase", "position": F.col("rank").cast("long"), "argv": F.col("event_type"),
    })
    return lookups.run_summary(calls, ["user_id"]).drop("chars_mean")


@query("select number, case when number % 5 = 0 then 'new' else label end as label from h_threads where not (number % 10 = 0)")
def labels_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth thread gets one new label, every tenth loses its labels."""
    heads = view(spark, d, "h_threads").withColumn("repo", F.lit("org/r"))
    wanted = heads.where("number % 5 = 0 and number % 10 <> 0").select("repo", "number", F.lit("new").alias("label"))
    return lookups.replaced_labels(heads.select("repo", "number", "label"), wanted, heads.where("number % 5 = 0")).select("number", "label")


@query(
    """with s as (select n_nationkey as k, n_regionkey as r from nation)
select 'org/r' || cast(k as varchar(20)) as repo, 'threads' as pass, case when k % 3 = 0 then -1 when k % 3 = 1 then k + 100 else k end as cursor from s
union all select 'org/r' || cast(k as varchar(20)), 'sweep', k * 2 from s"""
)
def pass_cursors(spark: SparkSession, d: str) -> DataFrame:
    """Two passes of each repository: some thread passes end or go on, the sweeps keep their cursors."""
    k, repo = F.col("n_nationkey").cast("long"), F.concat(F.lit("org/r"), F.col("n_nationkey").cast("string")).alias("repo")
    nations = table(spark, d, "nation")
    state = nations.select(repo, F.lit("threads").alias("pass"), k.alias("cursor")).unionByName(nations.select(repo, F.lit("sweep").alias("pass"), (k * 2).alias("cursor")))
    steps = nations.where("n_nationkey % 3 <> 2").select(repo, F.lit("threads").alias("pass"), (k + 100).alias("cursor"), (F.col("n_nationkey") % 3 == 0).alias("done"))
    return lookups.progressed(state, steps).withColumn("cursor", F.coalesce("cursor", F.lit(-1)))


@query(
    """with q as (select doc_id, case when doc_id % 2 = 0 then '  Cache   MASK ' else 'cache mask' end || ' ' || cast(doc_id % 30 as varchar(20)) as asked from labels)
select q.doc_id, cast(n.n_nationkey as bigint) as example from q join nation n on trim(regexp_replace(lower(q.asked), '\\s+', ' ', 'g')) = 'cache mask ' || cast(n.n_nationkey as varchar(20))""".replace("\\\\", "\\")
)
def labelled_examples(spark: SparkSession, d: str) -> DataFrame:
    from threadloom.operators.evaluation import question_key

    asked = F.concat(F.when(F.col("doc_id") % 2 == 0, "  Cache   MASK ").otherwise("cache mask"), F.lit(" "), (F.col("doc_id") % 30).cast("string"))
    labels = table(spark, d, "labels").select("doc_id", asked.alias("query"))
    examples = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("cache mask "), F.col("n_nationkey").cast("string")).alias("query"))
    return lookups.labelled_examples(labels, examples, question_key(F.lit("failure"), F.col("query"), F.lit(""))).select("doc_id", "example")


@query("select number, comment, 'run,Config_' || cast(number % 9 as varchar(20)) as terms from h_posts")
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    posts = view(spark, d, "h_posts").select("number", "comment", F.regexp_replace("body", r"\(\)`", "`").alias("body"))
    spans = F.regexp_replace("body", r"mod_\d+\.run`", "mod_x.runs`")
    return posts.select("number", "comment", F.regexp_replace(F.array_join(lookups.query_terms(spans, F.lit("")), ","), "runs", "run").alias("terms"))


@query("select number, 'valueerror,expected,features' as words, 'repo:org/r' as shortest, 'features expected repo:org/r' as longer from h_error_text group by number")
def distinctive_words(spark: SparkSession, d: str) -> DataFrame:
    found = dealt(spark, d, "h_error_text").select("number", lookups.distinctive(F.col("body")).alias("w"))
    scope = F.array(F.lit("repo:org/r"))
    cut = F.slice("w", 2, 2)
    return found.select("number", F.array_join("w", ",").alias("words"), lookups.fitted(cut, scope, 12).alias("shortest"), lookups.fitted(cut, scope, 40).alias("longer")).distinct()


@query("select n_nationkey as k, case n_nationkey % 5 when 0 then n_nationkey * 1.0 when 1 then n_nationkey * 60.0 when 2 then n_nationkey * 3600.0 when 3 then n_nationkey + 0.5 end as seconds from nation")
def interval_seconds(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("n_nationkey") % 5, F.col("n_nationkey").cast("string")
    value = F.when(k == 0, F.concat(s, F.lit("s"))).when(k == 1, F.concat(F.lit(" "), s, F.lit("m"))).when(k == 2, F.concat(s, F.lit("h"))).when(k == 3, F.concat(s, F.lit(".5"))).otherwise(F.concat(s, F.lit("x")))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), lookups.interval_seconds(value).alias("seconds"))


# -- evaluation sets: examples and labels made of the test tables -------------------------------------------------------------


def _examples(spark: SparkSession, d: str) -> DataFrame:
    o, none = F.col("o_orderkey"), F.array().cast("array<string>")
    relevant = F.array(F.struct(F.lit("org/r").alias("repo"), o.cast("long").alias("number"), F.lit("").alias("why")))
    return table(spark, d, "orders").select(
        F.concat(F.lit("x"), (F.col("o_custkey") * 7 + o % 3).cast("string")).alias("id"), F.when(o % 11 == 0, "other").otherwise("failure").alias("kind"), F.when(o % 5 == 0, " ").otherwise(F.col("o_orderpriority")).alias("query"),
        F.when(o % 2 == 0, F.array(F.col("o_orderpriority"))).otherwise(none).alias("files"), none.alias("symbols"), none.alias("errors"), none.alias("tests"),
        F.when(o % 7 != 0, relevant).alias("relevant"), F.when(o % 3 == 0, "human").when(o % 13 == 0, "nobody").alias("judged_by"), F.lit("").alias("note"),
    )


@query(
    """with e as (select 'x' || cast(o_custkey * 7 + o_orderkey % 3 as varchar) as id, o_orderkey as o from orders),
f as (select id, 'unknown slice' as fault from e where o % 11 = 0
  union all select id, 'unknown judge' from e where o % 3 <> 0 and o % 13 = 0
  union all select id, 'judged without a relevant thread' from e where (o % 3 = 0 or o % 13 = 0) and o % 7 = 0
  union all select id, 'asks nothing' from e where o % 5 = 0 and o % 2 <> 0
  union all select id, 'duplicate id' from e group by 1 having count(*) > 1)
select id, fault, count(*) as n from f group by all"""
)
def dataset_faults(spark: SparkSession, d: str) -> DataFrame:
    return datasets.faults(_examples(spark, d)).groupBy("id", "fault").agg(F.count("*").alias("n"))


@query(
    """with e as (select distinct 'x' || cast(o_custkey * 7 + o_orderkey % 3 as varchar) as id from orders where o_orderkey % 4 = 0), n as (select distinct 'x' || cast(o_custkey * 7 + o_orderkey % 3 as varchar) as id from orders)
select id, count(*) as n from (select * from e union all select * from n where id not in (select id from e)) group by 1"""
)
def dataset_added(spark: SparkSession, d: str) -> DataFrame:
    """Ids of a set after examples were added of which it had some."""
    every = _examples(spark, d)
    known = every.join(_fourth(spark, d), "id", "left_semi").dropDuplicates(["id"])
    return datasets.added(known, every).groupBy("id").agg(F.count("*").alias("n"))


def _fourth(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderkey % 4 = 0").select(F.concat(F.lit("x"), (F.col("o_custkey") * 7 + F.col("o_orderkey") % 3).cast("string")).alias("id"))


@query(
    """with r as (select event_id, user_id % 4 <> 0 as may, case event_type when 'click' then 'relevant' when 'view' then 'decisive' when 'error' then 'wrong' else 'not_relevant' end as verdict, user_id % 3 as f from events)
select verdict, count(*) as n, cast(sum(f) as bigint) as filters from r where may and verdict <> 'wrong' group by 1"""
)
def labels_appended(spark: SparkSession, d: str) -> DataFrame:
    """What is stored of a batch of label requests: those of tokens that may label, with a known verdict, without empty filters."""
    e, path = table(spark, d, "events"), f"{shared_folder(spark)}/labels/{uuid.uuid4().hex}"
    verdict = F.when(F.col("event_type") == "click", "relevant").when(F.col("event_type") == "view", "decisive").when(F.col("event_type") == "error", "wrong").otherwise("not_relevant")
    files = F.when(F.col("user_id") % 3 > 0, F.array_repeat(F.lit("a.py"), (F.col("user_id") % 3).cast("int"))).otherwise(F.array().cast("array<string>"))
    asked = e.select(F.when(F.col("user_id") % 4 == 0, F.array(F.lit("read"))).otherwise(F.array(F.lit("read"), F.lit("label"))).alias("scopes"), verdict.alias("verdict"), F.create_map(F.lit("files"), files, F.lit("tests"), F.array().cast("array<string>")).alias("filters"))
    datasets.append_labels(asked, path)
    stored = spark.read.schema("verdict string, filters map<string,array<string>>").json(path)
    return stored.groupBy("verdict").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size(F.try_element_at("filters", F.lit("files"))), F.lit(0))).alias("filters"))
