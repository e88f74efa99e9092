"""Reading threads, claims, people, samples, provenance and briefing."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import filters, provenance, threads
from threadloom.plans.catalogue_search import SQL_ORDER
from threadloom.plans.registry import query
from threadloom.plans.views import dealt, in_repo, table, view

_CLAIMS = """l as (select k.*, t.repo, t.state, t.created_at, t.author from h_links k join h_threads t using (number)),
c as (select *, row_number() over (partition by repo, target_number order by case when state = 'open' then 0 else 1 end, created_at desc nulls last, number) as position, count(*) over (partition by repo, target_number) as total from l)"""


@query(_CLAIMS + " select repo, target_number, number, state, position, total from c where position <= 10")
def inflight_claims(spark: SparkSession, d: str) -> DataFrame:
    rows = threads.claims(in_repo(spark, d, "h_links"), view(spark, d, "h_threads"))
    return rows.select("repo", "target_number", "number", "state", F.col("position").cast("long").alias("position"), "total")


@query(
    """c as (select *, row_number() over (partition by repo, target_number order by case when state = 'open' then 0 else 1 end, created_at desc nulls last, number) as position, count(*) over (partition by repo, target_number) as total
  from h_twice where thread_type = 'pr' and target_number % 5 = 0)
select repo, target_number, number, state, position, total from c where position <= 10"""
)
def claims_two_repos(spark: SparkSession, d: str) -> DataFrame:
    """Claims on some numbers where two repositories have the same numbers."""
    rows = view(spark, d, "h_twice")
    links = rows.where("thread_type = 'pr'").select("repo", "number", "target_number")
    targets = rows.where("target_number % 5 = 0").select("repo", "target_number").distinct()
    found = threads.claims(links, rows.drop("target_number"), targets)
    return found.select("repo", "target_number", "number", "state", F.col("position").cast("long").alias("position"), "total")


@query("select repo, count(*) as links from h_links join h_threads using (number) group by repo")
def links_indexed(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "h_links").join(view(spark, d, "h_threads"), "number").groupBy("repo").agg(F.count("*").alias("links"))


@query(
    """l as (select k.number, repo, target_number from h_links k join h_threads using (number))
select l.number, l.repo, l.target_number, t.number is not null as resolved from l left join h_threads t on l.repo = t.repo and l.target_number = t.number"""
)
def link_resolution_left(spark: SparkSession, d: str) -> DataFrame:
    heads = view(spark, d, "h_threads")
    return threads.resolved(view(spark, d, "h_links").join(heads.select("number", "repo"), "number"), heads).select("number", "repo", "target_number", "resolved")


@query(
    """c as (select number, author, trust, source_id, created_at from h_documents where source_type not in ('title', 'body')),
m as (select number, count(distinct source_id) as machine_comments from c where trust = 'machine' group by 1),
p as (select number, author, trust, count(distinct source_id) as comments, max(created_at) as last_at from c where trust <> 'machine' group by all),
r as (select *, row_number() over (partition by number order by case when trust = 'authoritative' then 0 else 1 end, last_at desc nulls last, author, trust) as position from p)
select r.number, author, trust, comments, position, coalesce(machine_comments, 0) as machine_comments from r left join m using (number) where position <= 8"""
)
def participants(spark: SparkSession, d: str) -> DataFrame:
    rows = threads.participants(filters.commentary(view(spark, d, "h_documents")), ["number"])
    return rows.select("number", "author", "trust", "comments", F.col("position").cast("long").alias("position"), "machine_comments")


@query(
    """select repo, author, count(*) filter (thread_type = 'issue') as issues, count(*) filter (thread_type = 'pr') as prs, count(*) filter (thread_type = 'pr' and merged_at is not null) as merged,
strftime(min(created_at), '%Y-%m-%d') as first_at from h_threads group by repo, author"""
)
def author_record(spark: SparkSession, d: str) -> DataFrame:
    return threads.author_records(view(spark, d, "h_threads")).withColumn("first_at", F.date_format("first_at", "yyyy-MM-dd"))


@query(
    """r as (select *, row_number() over (partition by number order by case when trust = 'authoritative' then 1 else 0 end desc, l_extendedprice desc, chunk_index desc, source_id desc, l_suppkey desc) as n
  from h_documents where trust in ('authoritative', 'reported') and source_type = 'review_comment' and (path = 'm7.py' or ends_with(path, '/m7.py')))
select number, source_id, chunk_index, author, trust from r where n = 1"""
)
def anchored_comments(spark: SparkSession, d: str) -> DataFrame:
    docs = view(spark, d, "h_documents").where("source_type = 'review_comment'")
    rows = threads.anchored(docs, filters.file_matches(F.col("path"), ["m7.py"]), ["number"], F.col("l_extendedprice"), [F.col("chunk_index"), F.col("source_id"), F.col("l_suppkey")])
    return rows.select("number", "source_id", "chunk_index", "author", "trust")


@query("select number, source_type, source_id, count(*) as passages from h_documents group by all")
def passage_counts(spark: SparkSession, d: str) -> DataFrame:
    return threads.passages(view(spark, d, "h_documents"), ["number"])


@query(
    """r as (select *, row_number() over (partition by number, source_type, source_id order by chunk_index, l_suppkey, l_extendedprice, created_at) as n from h_documents)
select number, source_type, source_id, chunk_index, author from r where n = 1"""
)
def one_per_comment(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col(c) for c in ("chunk_index", "l_suppkey", "l_extendedprice", "created_at")]
    return threads.first_chunks(view(spark, d, "h_documents"), ["number"], order).select("number", "source_type", "source_id", "chunk_index", "author")


@query("select number, string_agg(body_text, chr(10) || chr(10) order by comment) as body, count(*) as chunks from h_conv group by number")
def body_rejoin(spark: SparkSession, d: str) -> DataFrame:
    return threads.rejoined(view(spark, d, "h_conv"), ["number"], F.col("body_text"), F.col("comment"))


_CONV = "c as (select number, comment, author, trust, row_number() over (partition by number order by comment) as position, count(*) over (partition by number) as n from h_conv)"


@query(
    _CONV
    + """, m as (select *, position > 1 and position <= n - 1 as middle, position > 1 and position <= n - 1 and trust = 'authoritative' as review from c),
i as (select *, row_number() over (partition by number, middle, review order by comment) - 1 as i, count(*) over (partition by number, middle, review) as m, count(*) filter (review) over (partition by number) as reviews from m),
r as (select *, case when review then 2 else 2 - least(reviews, 2) end as room from i)
select number, comment, author from r where n <= 4 or not middle or (room > 0 and (m <= room or (room > 1 and i in (0, cast(round_even((m - 1) / (room - 1), 0) as bigint))) or (room = 1 and i = 0)))"""
)
def ends_and_middle(spark: SparkSession, d: str) -> DataFrame:
    rows = threads.ends_and_middle(view(spark, d, "h_conv"), ["number"], [F.col("comment")], F.col("trust") == "authoritative", head=1, tail=1, slots=2)
    return rows.select("number", "comment", "author")


@query(_CONV + " select number, comment, author from c where position <= 2 or position > n - 3")
def ends_sample(spark: SparkSession, d: str) -> DataFrame:
    return threads.ends(view(spark, d, "h_conv"), ["number"], [F.col("comment")], 5).select("number", "comment", "author")


@query(
    """select number, source_type, source_id, chunk_index from h_documents where created_at is null or created_at > timestamp '1999-03-01'
or (created_at = timestamp '1999-03-01' and (source_type > 'review' or (source_type = 'review' and source_id > 500)))"""
)
def after_cursor(spark: SparkSession, d: str) -> DataFrame:
    return threads.after(view(spark, d, "h_documents"), datetime(1999, 3, 1, tzinfo=UTC), "review", 500).select("number", "source_type", "source_id", "chunk_index")


_FLAT = r"trim(regexp_replace(body_text, '\s+', ' ', 'g'))"


@query(
    f"""f as (select number, comment, author, {_FLAT} as t from h_conv),
c as (select *, row_number() over (partition by number order by comment) as position, count(*) over (partition by number) as reachable from f)
select number, comment, author, case when length(t) <= 60 then t else substr(t, 1, 59) || '…' end as line, reachable from c where position <= 100"""
)
def outline(spark: SparkSession, d: str) -> DataFrame:
    return threads.outline(view(spark, d, "h_conv"), ["number"], [F.col("comment")]).select("number", "comment", "author", "line", "reachable")


@query(
    """c as (select number, comment, cast(contains(lower(body_text), 'the') as int) + cast(contains(lower(body_text), 'ung') as int) + cast(contains(lower(body_text), 'eau') as int) as carried from h_conv)
select number, comment, carried from c where carried > 0"""
)
def focus_narrow(spark: SparkSession, d: str) -> DataFrame:
    return threads.focused(view(spark, d, "h_conv"), ["the", "ung", "eau"]).select("number", "comment", "carried")


@query(
    """a as (select number, 'src/m' || cast(number % 50 as varchar(20)) || '.py' as at_path, 3 as at_line from h_threads),
r as (select d.*, t.repo, chunk_index * 2 as line from h_documents d join h_threads t using (number) where source_type in ('review', 'review_comment')),
m as (select r.*, case when path = at_path and abs(line - at_line) <= 3 then 0 when path = at_path then 1 else 2 end as level from r join a using (number)),
b as (select *, min(level) over (partition by repo, number) as best from m)
select number, source_type, source_id, chunk_index, l_suppkey, level from b where level = best"""
)
def why_argument_levels(spark: SparkSession, d: str) -> DataFrame:
    heads = view(spark, d, "h_threads")
    anchors = heads.select("repo", "number", F.concat(F.lit("src/m"), (F.col("number") % 50).cast("string"), F.lit(".py")).alias("path"), F.lit(3).alias("line"))
    reviews = view(spark, d, "h_documents").where("source_type in ('review', 'review_comment')").join(heads.select("number", "repo"), "number").withColumn("line", F.col("chunk_index") * 2)
    return provenance.argument(reviews, anchors, 3).select("number", "source_type", "source_id", "chunk_index", "l_suppkey", "level")


@query(
    """k as (select repo, number, sha256('c' || cast(number as varchar(20))) as sha from h_threads where number % 3 <> 0),
q as (select repo, number as n, case when number % 2 = 0 then sha256('c' || cast(number as varchar(20))) else sha256('x' || cast(number as varchar(20))) end as sha, case when number % 5 = 0 then 'fix it (#' || cast(number as varchar(20)) || ')' else 'fix it' end as summary from h_threads),
j as (select q.repo, q.sha, k.number, case when regexp_matches(summary, '\\(#(\\d+)\\)\\s*$') then cast(regexp_extract(summary, '\\(#(\\d+)\\)\\s*$', 1) as bigint) end as guess from q left join k on q.repo = k.repo and q.sha = k.sha)
select repo, sha, coalesce(number, guess) as number, number is null and guess is not null as guessed from j where coalesce(number, guess) is not null""".replace("\\\\", "\\")
)
def sha_prefix_join(spark: SparkSession, d: str) -> DataFrame:
    heads = view(spark, d, "h_threads")
    sha = lambda p: F.sha2(F.concat(F.lit(p), F.col("number").cast("string")), 256)
    commits = heads.where("number % 3 <> 0").select("repo", "number", sha("c").alias("sha"))
    summary = F.when(F.col("number") % 5 == 0, F.concat(F.lit("fix it (#"), F.col("number").cast("string"), F.lit(")"))).otherwise("fix it")
    asked = heads.select("repo", F.when(F.col("number") % 2 == 0, sha("c")).otherwise(sha("x")).alias("sha"), summary.alias("summary"))
    return provenance.threads_of_commits(asked, commits, heads)


@query(
    """k as (select repo, number, lpad(cast(number as varchar(20)), 40, '0') as sha from h_twice where thread_type = 'pr'),
q as (select distinct repo, lpad(cast(number as varchar(20)), 40, '0') as sha, 'merge (#' || cast(number + 1 as varchar(20)) || ')' as summary, number + 1 as guess from h_twice)
select q.repo, q.sha, coalesce(k.number, guess) as number, k.number is null as guessed from q left join k on q.repo = k.repo and q.sha = k.sha"""
)
def why_threads(spark: SparkSession, d: str) -> DataFrame:
    """Blamed commits whose shas have their first 12 characters in common, in two repositories."""
    rows = view(spark, d, "h_twice").withColumn("sha", F.lpad(F.col("number").cast("string"), 40, "0"))
    asked = rows.select("repo", "sha", F.concat(F.lit("merge (#"), (F.col("number") + 1).cast("string"), F.lit(")")).alias("summary")).distinct()
    return provenance.threads_of_commits(asked, rows.where("thread_type = 'pr'").select("repo", "number", "sha"), rows)


@query(
    """f as (select repo, number, path, source, merged_at from h_files join h_threads using (number)),
w as (select distinct repo, number as asked, path from f), m as (select distinct repo, number, path, merged_at from f where source = 'changed' and merged_at is not null),
s as (select repo, asked, number, merged_at, count(*) as shared from m join w using (repo, path) where number <> asked group by all),
r as (select *, row_number() over (partition by repo, asked order by shared desc, merged_at desc, number) as position from s)
select asked, number, repo, shared, position from r where position <= 5"""
)
def brief_file_history(spark: SparkSession, d: str) -> DataFrame:
    heads = view(spark, d, "h_threads")
    files = dealt(spark, d, "h_files").join(heads.select("repo", "number"), "number")  # dealt by number once: what is distinct, joined and grouped by it stays there
    rows = provenance.file_histories(files, heads)
    return rows.select("asked", "number", "repo", "shared", F.col("position").cast("long").alias("position"))


@query(
    """r as (select number, path, min(case source when 'changed' then 0 when 'comment' then 1 else 2 end) as level from h_files group by 1, 2)
select number, path, case level when 0 then 'changed' when 1 then 'comment' else 'mentioned' end as source from r"""
)
def file_provenance(spark: SparkSession, d: str) -> DataFrame:
    return threads.provenance(view(spark, d, "h_files"), ["number"])


@query(
    """r as (select number, author, case l_suppkey % 4 when 0 then 'APPROVED' when 1 then 'CHANGES_REQUESTED' when 2 then 'DISMISSED' else 'COMMENTED' end as state, created_at, chunk_index, source_id, l_suppkey, l_extendedprice
  from h_documents where source_type = 'review'),
l as (select *, row_number() over (partition by number, author order by created_at desc, chunk_index desc, source_id desc, l_suppkey desc, l_extendedprice desc) as n from r where state <> 'COMMENTED'),
g as (select number, string_agg(distinct case when state = 'CHANGES_REQUESTED' then author end, ',' order by case when state = 'CHANGES_REQUESTED' then author end) as b,
  string_agg(distinct case when state = 'APPROVED' then author end, ',' order by case when state = 'APPROVED' then author end) as o from l where n = 1 group by number)
select number, case when b is not null then 'CHANGES_REQUESTED' else 'APPROVED' end as decision, coalesce(b, o) as decided_by from g where b is not null or o is not null"""
)
def review_decision(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_suppkey") % 4
    state = F.when(k == 0, "APPROVED").when(k == 1, "CHANGES_REQUESTED").when(k == 2, "DISMISSED").otherwise("COMMENTED")
    reviews = view(spark, d, "h_documents").where("source_type = 'review'").withColumn("state", state)
    rows = threads.review_decision(reviews, ["number"], ties=[F.col(c) for c in ("chunk_index", "source_id", "l_suppkey", "l_extendedprice")])
    return rows.withColumn("decided_by", F.array_join("decided_by", ","))


@query("select repo, number, state, author from h_threads where number in (select target_number from h_links)")
def thread_heads(spark: SparkSession, d: str) -> DataFrame:
    targets = view(spark, d, "h_links").select(F.col("target_number").alias("number")).distinct()
    return view(spark, d, "h_threads").join(targets, "number", "left_semi").select("repo", "number", "state", "author")


@query(
    """d as (select number, count(*) as documents from h_documents group by 1)
select repo, thread_type, count(*) as threads, cast(sum(coalesce(documents, 0)) as bigint) as documents from h_threads left join d using (number) group by 1, 2"""
)
def status_summary(spark: SparkSession, d: str) -> DataFrame:
    docs = view(spark, d, "h_documents").groupBy("number").agg(F.count("*").alias("documents"))
    return view(spark, d, "h_threads").join(docs, "number", "left").groupBy("repo", "thread_type").agg(F.count("*").alias("threads"), F.sum(F.coalesce("documents", F.lit(0))).alias("documents"))


@query(
    """p as (select number, 'lib' || cast(l_suppkey % 5 as varchar(20)) || '/' || path as path from h_documents),
g as (select number, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) as directory, count(*) as files from p group by 1, 2),
r as (select *, row_number() over (partition by number order by files desc, directory) as position, count(*) over (partition by number) as directories from g)
select number, case when position <= 3 then directory else '(rest)' end as directory, directories, cast(sum(files) as bigint) as files from r group by 1, 2, 3"""
)
def path_shape(spark: SparkSession, d: str) -> DataFrame:
    files = view(spark, d, "h_documents").select("number", F.concat(F.lit("lib"), (F.col("l_suppkey") % 5).cast("string"), F.lit("/"), F.col("path")).alias("path"))
    return threads.path_shape(files, ["number"])


@query(f"select number, source_type, source_id from (select *, row_number() over (partition by number order by {SQL_ORDER}) as n from h_documents where source_type in ('issue_comment', 'review', 'review_comment')) where n = 1")
def latest_engagement(spark: SparkSession, d: str) -> DataFrame:
    rows = filters.engagement(view(spark, d, "h_documents").withColumn("thread_author", F.lit("nobody")))
    top = F.max_by(F.struct("source_type", "source_id"), F.struct("created_at", "chunk_index", "source_id", "l_suppkey", "l_extendedprice"))
    return rows.groupBy("number").agg(top.alias("h")).select("number", "h.*")


@query("select number, count(*) as comments from h_conv group by number order by comments desc, number limit 20")
def longest_threads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy(F.col("conv_id").alias("number")).agg(F.count("*").alias("comments")).orderBy(F.col("comments").desc(), "number").limit(20)


@query("select repo, number from h_threads where thread_type = 'pr' and merged_at is not null union all select repo, number from h_threads where thread_type = 'pr' and state = 'open' and merged_at is null and number > 1000")
def merged_or_open_pulls(spark: SparkSession, d: str) -> DataFrame:
    heads = view(spark, d, "h_threads")
    return filters.merged_pulls(heads).select("repo", "number").unionByName(filters.open_pulls(heads, 1000).select("repo", "number"))
