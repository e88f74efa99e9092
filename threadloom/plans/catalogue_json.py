"""Queries of JSON texts: strings scrubbed at any depth, payloads without mirrors, results as served."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import json_tree
from threadloom.operators import projections, threads
from threadloom.plans.registry import query
from threadloom.plans.views import in_repo, table, view

NOW = "2025-01-01"


@query(
    r"""with t as (select page_id, html || ' <|im_start|>"\' || chr(10) || '[INST]' as x from pages),
a as (select page_id, regexp_replace(regexp_replace(x, '[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{feff}]', '', 'g'), '[\x00-\x08\x0b-\x1f\x7f\x{80}-\x{9f}]', '', 'g') as x from t),
b as (select page_id, regexp_replace(regexp_replace(x, '(?i)<<<\s*/?\s*THREADLOOM[A-Z0-9_\- ]*>>>', '[SCRUBBED:delimiter]', 'g'), '<\|([^|>\n]{1,48})\|>', '[SCRUBBED:special-token \1]', 'g') as x from a)
select page_id, sha256(regexp_replace(x, '(?i)<</?(SYS)>>|\[/?(INST)\]', '[SCRUBBED:special-token \1\2]', 'g')) as text_sha256, 'null' as nothing, '1.50' as exact from b"""
)
def scrubbed_trees(spark: SparkSession, d: str) -> DataFrame:
    """Whole pages inside a nested payload, scrubbed where they stand and read back."""
    text = F.concat("html", F.lit(' <|im_start|>"\\\n[INST]'))
    inner = F.to_json(F.struct(F.array(F.struct(text.alias("text"), F.lit(None).cast("string").alias("nothing"))).alias("comments")), {"ignoreNullFields": "false"})
    tree = F.concat(F.lit('{"a": {"exact": 1.50, "b": ['), inner, F.lit("]}}"))
    rows = table(spark, d, "pages").select("page_id", json_tree.scrub_tree(tree).alias("tree"))
    return rows.select(
        "page_id", F.sha2(F.get_json_object("tree", "$.a.b[0].comments[0].text").cast("binary"), 256).alias("text_sha256"), F.regexp_extract("tree", r'"nothing":(null)', 1).alias("nothing"), F.regexp_extract("tree", r'"exact": ([0-9.]+)', 1).alias("exact")
    )


@query(
    """select c_custkey as number, '{"number":' || c_custkey || ',"title":"customer ' || c_custkey || '","html_url":"https://h/' || c_custkey || '","user":{"login":"u' || c_custkey % 97 || '","id":' || c_custkey || ',"type":"User"},"parts":[{"html_url":null,"state":"s' || c_nationkey || '"}]}' as payload from customer"""
)
def mirrors_stripped(spark: SparkSession, d: str) -> DataFrame:
    """A payload a customer, with mirrored links at every level, as it is stored."""
    n = F.col("c_custkey")
    link = lambda *of: F.concat(F.lit("https://api/"), *of, n.cast("string"))
    user = F.struct(F.concat(F.lit("u"), (n % 97).cast("string")).alias("login"), link().alias("avatar_url"), n.alias("id"), F.lit("User").alias("type"), link().alias("url"), F.lit("x").alias("node_id"))
    part = F.struct(link().alias("url"), F.lit(None).cast("string").alias("html_url"), F.concat(F.lit("s"), F.col("c_nationkey").cast("string")).alias("state"), F.struct(link().alias("href")).alias("_links"))
    whole = F.struct(
        n.alias("number"), link().alias("url"), F.concat(F.lit("customer "), n.cast("string")).alias("title"), link().alias("comments_url"), F.concat(F.lit("https://h/"), n.cast("string")).alias("html_url"), user.alias("user"),
        F.struct(F.lit(1).alias("id")).alias("repository"), F.array(part).alias("parts"), F.struct(F.lit(2).alias("id")).alias("performed_via_github_app"),
    )
    return table(spark, d, "customer").select(n.alias("number"), json_tree.without_mirrors(F.to_json(whole, {"ignoreNullFields": "false"})).alias("payload"))


_AGE = f"cast(cast(round_even(date_diff('second', created_at, timestamp '{NOW}') / 86400.0 / 365.25, 0) as bigint) as varchar) || 'y'"
_DATE = "strftime(created_at, '%Y-%m-%dT%H:%M:%SZ')"


@query(
    f"""l as (select k.*, t.* exclude (number) from h_links k join h_threads t using (number)),
c as (select *, row_number() over (partition by repo, target_number order by case when state = 'open' then 0 else 1 end, created_at desc nulls last, number) as position, count(*) over (partition by repo, target_number) as total from l),
j as (select repo, target_number, position, total, '{{"repo":"' || repo || '","number":' || number || ',"type":"' || thread_type || '","title":null,"url":null,"author":"' || author || '","state":"' || state || '","draft":null,"merged":' || case when merged_at is null then 'false' else 'true' end
|| ',"state_reason":null,"closed_by":null,"review_decision":null,"age":"' || {_AGE} || '","date":"' || {_DATE} || '","relationship":"' || relationship || '"}}' as claim from c where position <= 10),
p as (select repo, target_number, string_agg(claim, ',' order by position) as claims, count(*) as returned, max(total) as total from j group by 1, 2), n as (select repo, count(*) as links from l group by 1)
select t.repo, t.number, '{{"repo":"' || t.repo || '","number":' || t.number || ',"claims":[' || coalesce(claims, '') || '],"claims_returned":' || coalesce(returned, 0) || ',"claims_total":' || coalesce(total, 0) || ',"links_indexed":' || coalesce(links, 0) || '}}' as json
from h_threads t left join p on p.repo = t.repo and p.target_number = t.number left join n on n.repo = t.repo"""
)
def inflight_json(spark: SparkSession, d: str) -> DataFrame:
    """What claims to close each thread, as it is served."""
    heads, links = view(spark, d, "h_threads"), in_repo(spark, d, "h_links")
    return projections.inflight_json(heads, threads.claims(links, heads), links, F.to_timestamp(F.lit(NOW)))


@query(
    f"""o as (select * from (select h.number, t.repo, source_type, source_id, chunk_index, h.author, trust, h.created_at, row_number() over (partition by repo, number order by chunk_index, source_id, h.author, trust, h.created_at) as position, count(*) over (partition by repo, number) as total from h_documents h join h_threads t using (number) where source_type not in ('title', 'body') and trust <> 'machine') where position <= 10),
m as (select number, count(*) as machine from h_documents where source_type not in ('title', 'body') and trust = 'machine' group by 1),
j as (select repo, number, total, position, '{{"repo":"' || repo || '","number":' || number || ',"type":null,"title":null,"source_type":"' || source_type || '","url":null,"author":"' || author || '","trust":"' || trust || '","age":"' || {_AGE} || '","date":"' || {_DATE}
|| '","snippet":null,"document_id":"' || source_type || ':' || source_id || ':' || chunk_index || '","source_id":' || source_id || ',"chunk_index":' || chunk_index || '}}' as comment from o),
p as (select repo, number, string_agg(comment, ',' order by position) as comments, count(*) as returned, max(total) as total from j group by 1, 2),
f as (select number, coalesce(string_agg('"' || path || '"', ',' order by path) filter (source = 'changed'), '') as changed, coalesce(string_agg('"' || path || '"', ',' order by path) filter (source = 'mentioned'), '') as mentioned from h_files group by 1)
select repo, number, '{{"repo":"' || repo || '","number":' || number || ',"type":"' || thread_type || '","title":null,"url":null,"author":"' || author || '","state":"' || state || '","age":"' || {_AGE} || '","date":"' || {_DATE} || '","labels":["' || label || '"],"state_reason":null,"closed_by":null,"merged":'
|| case when merged_at is null then 'false' else 'true' end || ',"review_decision":null,"body":null,"body_chars":null,"body_truncated":null,"files_changed":[' || coalesce(changed, '') || '],"files_anchored":[],"files_mentioned":[' || coalesce(mentioned, '') || '],"comments":[' || coalesce(comments, '') || '],"comments_returned":' || coalesce(returned, 0)
|| ',"comments_total":' || coalesce(total, 0) + coalesce(machine, 0) || ',"comments_machine_suppressed":' || coalesce(machine, 0) || '}}' as json from h_threads left join p using (repo, number) left join m using (number) left join f using (number)"""
)
def thread_json(spark: SparkSession, d: str) -> DataFrame:
    """Each thread with the first comments of people, and what the page leaves out, as it is served."""
    heads = view(spark, d, "h_threads").withColumn("labels", F.array("label"))
    said = in_repo(spark, d, "h_documents").where("source_type not in ('title', 'body')")
    people = said.where("trust <> 'machine'").withColumn("position", F.row_number().over(Window.partitionBy("repo", "number").orderBy("chunk_index", "source_id", "author", "trust", "created_at")))
    page = people.where("position <= 10").select("repo", "number", "position", "source_type", "source_id", "chunk_index", "author", "trust", "created_at")
    counts = said.groupBy("repo", "number").agg(F.count("*").alias("comments_total"), F.count_if(F.col("trust") == "machine").alias("comments_machine_suppressed"))
    return projections.thread_json(heads, page, counts, in_repo(spark, d, "h_files"), F.to_timestamp(F.lit(NOW)), compact=True)
