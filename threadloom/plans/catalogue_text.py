"""Cleaning, hashing, showing and extraction of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import extract, text
from threadloom.functions.chunking import chunked
from threadloom.plans.registry import query
from threadloom.plans.views import dealt, table, view

_NORMAL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\r\n?', chr(10), 'g'),
  '[\x{{200b}}-\x{{200f}}\x{{2028}}\x{{2029}}\x{{feff}}]', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '!\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\[([^\]]+)\]\(([^)]*)\)', '\1', 'g'), '\[\]\(([^)]*)\)', '\1', 'g'),
  '[ \t]+\n', chr(10), 'g'), '\n\n\n+', chr(10) || chr(10), 'g')"""


@query(rf"select doc_id, sha256(regexp_replace({_NORMAL.format('text')}, '^\s+|\s+$', '', 'g')) as normal_sha256 from documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(text.normalize(F.col("text")).cast("binary"), 256).alias("normal_sha256"))


@query(rf"select page_id, sha256(regexp_replace({_NORMAL.format('html')}, '^\s+|\s+$', '', 'g')) as normal_sha256 from pages")
def strip_html_comments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.sha2(text.normalize(F.col("html")).cast("binary"), 256).alias("normal_sha256"))


_SECRET = "concat('see ghp_', substr(sha256(cast(doc_id as varchar(20))), 1, 40), ' or https://u:pw', cast(doc_id as varchar(20)), '@host/x and AKIA', upper(substr(sha256(cast(doc_id as varchar(20))), 1, 16)), ' ', text)"


@query(
    rf"""with t as (select doc_id, {_SECRET} as x from documents),
a as (select doc_id, x, regexp_replace(x, '\bgh[pousr]_[A-Za-z0-9]{{36,255}}\b', '[REDACTED:github-token]', 'g') as y from t),
b as (select doc_id, x, y, regexp_replace(y, '\b(?:A3T[A-Z0-9]|AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{{16}}\b', '[REDACTED:aws-key-id]', 'g') as z from a)
select doc_id, len(regexp_extract_all(x, '\bgh[pousr]_[A-Za-z0-9]{{36,255}}\b')) as github_token, len(regexp_extract_all(y, '\b(?:A3T[A-Z0-9]|AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{{16}}\b')) as aws_key_id,
len(regexp_extract_all(z, '\b([a-zA-Z][a-zA-Z0-9+.\-]*)://([^\s:/@]+):([^\s/@]+)@')) as url_credentials,
sha256(regexp_replace(z, '\b([a-zA-Z][a-zA-Z0-9+.\-]*)://([^\s:/@]+):([^\s/@]+)@', '\1://\2:[REDACTED:url-credentials]@', 'g')) as redacted_sha256 from b"""
)
def redact_counts(spark: SparkSession, d: str) -> DataFrame:
    digest = F.sha2(F.col("doc_id").cast("string"), 256)
    x = F.concat(F.lit("see ghp_"), F.substring(digest, 1, 40), F.lit(" or https://u:pw"), F.col("doc_id").cast("string"), F.lit("@host/x and AKIA"), F.upper(F.substring(digest, 1, 16)), F.lit(" "), F.col("text"))
    found = text.redactions(x)
    names = {"github-token": "github_token", "aws-key-id": "aws_key_id", "url-credentials": "url_credentials"}
    return table(spark, d, "documents").select("doc_id", *(found[k].cast("long").alias(v) for k, v in names.items()), F.sha2(text.redact(x).cast("binary"), 256).alias("redacted_sha256"))


_MARKED = "concat('<|im_start|>x ', '[INST] <<SYS>> <<< /THREADLOOM end >>> ', html)"


@query(
    rf"""with t as (select page_id, {_MARKED} as x from pages),
a as (select page_id, regexp_replace(regexp_replace(x, '[\x{{200b}}-\x{{200f}}\x{{202a}}-\x{{202e}}\x{{2060}}-\x{{2064}}\x{{2066}}-\x{{2069}}\x{{feff}}]', '', 'g'), '[\x00-\x08\x0b-\x1f\x7f\x{{80}}-\x{{9f}}]', '', 'g') as x from t),
b as (select page_id, regexp_replace(x, '(?i)<<<\s*/?\s*THREADLOOM[A-Z0-9_\- ]*>>>', '[SCRUBBED:delimiter]', 'g') as x from a),
c as (select page_id, regexp_replace(x, '<\|([^|>\n]{{1,48}})\|>', '[SCRUBBED:special-token \1]', 'g') as x from b)
select page_id, sha256(regexp_replace(x, '(?i)<</?(SYS)>>|\[/?(INST)\]', '[SCRUBBED:special-token \1\2]', 'g')) as scrubbed_sha256 from c"""
)
def scrub_text(spark: SparkSession, d: str) -> DataFrame:
    x = F.concat(F.lit("<|im_start|>x [INST] <<SYS>> <<< /THREADLOOM end >>> "), F.col("html"))
    return table(spark, d, "pages").select("page_id", F.sha2(text.scrub(x).cast("binary"), 256).alias("scrubbed_sha256"))


@query("""select doc_id, sha256('1' || chr(0) || text || chr(0) || '{"lang":"' || lang || '","source":"' || source || '"}') as content_hash from documents""")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    meta = F.to_json(F.struct("lang", "source"))
    return table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text"), meta, F.lit(1)).alias("content_hash"))


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    cut = table(spark, d, "documents").select("doc_id", F.posexplode(chunked(F.col("text"))).alias("chunk_index", "chunk"))
    return cut.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.char_length("chunk").cast("long").alias("chars"), F.sha2("chunk", 256).alias("chunk_sha256"))


_ERROR_SQL = r"lower(trim(regexp_replace(regexp_replace({}, '[0-9]+', '<n>', 'g'), '\s+', ' ', 'g')))"


@query(f"select distinct number, {_ERROR_SQL.format(chr(39) + chr(39) + ' || body')} as message_norm from h_error_text")
def error_normalize(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "h_error_text").select("number", text.error_norm(F.col("body")).alias("message_norm")).distinct()


@query(f"select distinct number, 'ValueError' as exception_type, {_ERROR_SQL.format(chr(114) + 'eplace(body, ' + chr(39) + 'ValueError: ' + chr(39) + ', ' + chr(39) + chr(39) + ')')} as message_norm from h_error_text")
def extract_errors(spark: SparkSession, d: str) -> DataFrame:
    return extract.errors(dealt(spark, d, "h_error_text"), F.col("body"), "number")


@query(
    r"""w as (select number, unnest(regexp_extract_all(body, '[\w./-]+\.py::[\w:.-]*\w(?:\[[^\]\n]*\])?')) as written from h_posts),
b as (select number, written as test_id, written from w union select number, regexp_replace(written, '\[[^\]]*\]', '', 'g'), written from w),
f as (select number, test_id, regexp_replace(regexp_extract(written, '[^:.]*$'), '\[[^\]]*\]', '', 'g') as fn from b)
select distinct number, test_id, case when starts_with(fn, 'test') then fn end as test_function from f"""
)
def extract_tests(spark: SparkSession, d: str) -> DataFrame:
    return extract.tests(view(spark, d, "h_posts"), F.col("body"), "number")


@query(r"select distinct number, unnest(['src/m' || cast(number % 50 as varchar(20)) || '.py', 'tests/test_m' || cast(number % 7 as varchar(20)) || '.py']) as path from h_posts")
def extract_paths(spark: SparkSession, d: str) -> DataFrame:
    return extract.paths(view(spark, d, "h_posts"), F.col("body"), "number")


@query(
    r"""s as (select number, unnest(regexp_extract_all(body, '`([^`\n]+)`', 1)) as span from h_posts), g as (select number, regexp_replace(span, '\(\)$', '') as symbol, case when ends_with(span, '()') then 'call' end as symbol_type from s)
select number, symbol, max(symbol_type) as symbol_type from g group by 1, 2"""
)
def extract_symbols(spark: SparkSession, d: str) -> DataFrame:
    return extract.symbols(view(spark, d, "h_posts"), F.col("body"), "number").select("number", "symbol", "symbol_type")


@query(
    r"""c as (select number, cast(unnest(regexp_extract_all(body, '(?i)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\b\s*:?\s*#(\d+)', 1)) as bigint) as target_number from h_posts)
select distinct number, target_number from c where number <> target_number"""
)
def extract_links(spark: SparkSession, d: str) -> DataFrame:
    posts = view(spark, d, "h_posts").withColumns({"thread_type": F.lit("pr"), "source_type": F.lit("body")})
    return extract.links(posts, F.col("body"), "number")


_S = "(epoch_us(timestamp '2001-09-01') - epoch_us(created_at)) / 1e6"


@query(
    f"""a as (select number, chunk_index, source_id, l_suppkey, {_S} as s from h_documents)
select number, chunk_index, source_id, l_suppkey, case when s < 0 then '0h' when s < 3600 then '<1h' when s < 172800 then cast(cast(floor(s / 3600) as bigint) as varchar) || 'h' when s / 86400 < 60 then cast(cast(floor(s / 86400) as bigint) as varchar) || 'd'
  when s / 86400 / 30.44 < 24 then cast(cast(floor(s / 86400 / 30.44) as bigint) as varchar) || 'mo' else cast(cast(round_even(s / 86400 / 365.25, 0) as bigint) as varchar) || 'y' end as age from a"""
)
def age_render(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "h_documents").select("number", "chunk_index", "source_id", "l_suppkey", text.age(F.col("created_at"), F.lit("2001-09-01").cast("timestamp")).alias("age"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as stamp from events")
def stamp_render(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", text.stamp(F.col("ts")).alias("stamp"))


@query(
    r"""with f as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from documents),
p as (select doc_id, t, coalesce(least(nullif(instr(lower(t), 'thing'), 0), nullif(instr(lower(t), 'ung '), 0)), 1) - 1 as first from f),
s as (select doc_id, t, greatest(0, least(first - 53, length(t) - 160)) as start from p),
w as (select doc_id, t, start, substr(t, start + 1, 160) as win from s),
x as (select doc_id, t, start, case when start > 0 and instr(win, ' ') > 0 then substr(win, instr(win, ' ') + 1) else win end as win from w)
select doc_id, case when length(t) <= 160 then t else case when start > 0 then '…' else '' end || rtrim(win) || '…' end as snippet from x"""
)
def snippet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.snippet(F.col("text"), ["thing", "ung "], 160).alias("snippet"))


@query("select number, chunk_index, source_id, l_suppkey, case when l_suppkey % 7 = 0 then 'machine' when l_suppkey % 5 in (0, 1) then 'authoritative' when l_suppkey % 5 = 2 and l_suppkey % 3 = 0 then 'authoritative' else 'reported' end as tier from h_documents")
def trust_tier(spark: SparkSession, d: str) -> DataFrame:
    """Tiers by bot flag, association and a permission dimension that is joined by login."""
    docs = view(spark, d, "h_documents")
    authority = docs.select("l_suppkey").distinct().where("l_suppkey % 3 = 0").select("l_suppkey", F.lit("write").alias("permission"))
    rows = docs.join(authority, "l_suppkey", "left")
    association = F.element_at(F.array(*(F.lit(x) for x in ("OWNER", "COLLABORATOR", "MEMBER", "CONTRIBUTOR", "NONE"))), (F.col("l_suppkey") % 5 + 1).cast("int"))
    return rows.select("number", "chunk_index", "source_id", "l_suppkey", text.trust_tier(F.col("l_suppkey") % 7 == 0, association, F.col("permission")).alias("tier"))
