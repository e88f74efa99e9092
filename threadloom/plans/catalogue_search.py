"""Scope, filters, ranking, full text and fusion."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import decay, error_norm
from threadloom.operators import filters, fulltext, ranking, segments, substrings
from threadloom.operators.filters import Corpus, SearchQuery
from threadloom.plans.registry import query
from threadloom.plans.views import dealt, parts, table, view
from threadloom.sources.store import shared_folder

NEW_YEAR_2000 = datetime(2000, 1, 1, tzinfo=UTC)


def ties():
    return [F.col(c).desc() for c in ("number", "chunk_index", "source_id", "l_suppkey", "l_extendedprice")]


SQL_ORDER = "created_at desc nulls last, number desc, chunk_index desc, source_id desc, l_suppkey desc, l_extendedprice desc"


def corpus(spark: SparkSession, d: str) -> Corpus:
    v = lambda n: view(spark, d, n)
    errors = v("h_error_text").select("number", error_norm(F.regexp_extract("body", r"ValueError: (.*)", 1)).alias("message_norm")).distinct()
    return Corpus(v("h_threads"), v("h_documents"), v("h_files"), v("h_symbols"), errors, v("h_tests"), v("h_threads").select("number", "label"), v("h_links"), ("number",))




@query(
    f"""f as (select number, (max(case when path = 'src/m3.py' then 1 else 0 end) + max(case when path = 'src/m7.py' then 1 else 0 end)) / 2.0 as fo from h_files where path in ('src/m3.py', 'src/m7.py') group by 1),
y as (select number, (max(case when symbol = 'mod_5.run' then 1 else 0 end) + max(case when symbol = 'mod_9.run' then 1 else 0 end)) / 2.0 as so from h_symbols where symbol in ('mod_5.run', 'mod_9.run') group by 1),
s as (select d.*, t.repo, 1.5 * so + fo as score from h_documents d join h_threads t using (number) join f using (number) join y using (number)
  where repo in ('org/r0', 'org/r1', 'org/r2') and d.created_at < timestamp '2000-01-01' and trust in ('authoritative', 'reported')),
a as (select *, row_number() over (partition by number, source_type order by score desc nulls last, {SQL_ORDER}) as n1 from s),
b as (select *, row_number() over (partition by number order by score desc nulls last, {SQL_ORDER}) as n2 from a where n1 = 1)
select number, repo, source_type, source_id, chunk_index, author, round(score, 6) as score from b where n2 <= 3 order by score desc nulls last, {SQL_ORDER} limit 10"""
)
def search_select_page(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    q = SearchQuery(repos=("org/r0", "org/r1", "org/r2"), files=("m3.py", "src/m7.py"), symbols=("mod_5.run", "mod_9.run"), before=NEW_YEAR_2000).checked()
    rows = filters.admissible(c, replace(q, files=(), symbols=()))  # the inner joins of their scores filter by them
    page = ranking.select_page(ranking.scored(rows, c, q, required=("file", "symbol")), c.key, ties())
    return page.select("number", "repo", "source_type", "source_id", "chunk_index", "author", F.round("score", 6).alias("score"))


def _trust(kind: str | None, trust: str | None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = view(spark, d, "h_documents").join(view(spark, d, "h_threads").select("number", "repo", "merged_at"), "number").where(filters.trusted(kind, trust))
        return rows.groupBy("repo", "trust", "source_type").agg(F.count("*").alias("n"))

    return run


for _name, _kind, _floor, _where in (
    ("trust_floor_default", None, None, "trust in ('authoritative', 'reported')"),
    ("trust_floor_rationale", "rationale", None, "trust = 'authoritative'"),
    ("trust_floor_precedent", "precedent", None, "(trust = 'authoritative' or (merged_at is not null and trust in ('authoritative', 'reported')))"),
    ("trust_floor_machine", None, "machine", "trust in ('authoritative', 'reported', 'machine')"),
):
    query(f"select repo, trust, source_type, count(*) as n from h_documents d join (select number, repo, merged_at from h_threads) t using (number) where {_where} group by all", _name)(_trust(_kind, _floor))


@query("select d.number, source_type, source_id, chunk_index from h_documents d join h_threads t using (number) where repo in ('org/r1', 'org/r3') and d.created_at < timestamp '1999-06-01' and number not in (3, 7, 2001)")
def scope_cutoff_exclude(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "h_documents").join(view(spark, d, "h_threads").select("number", "repo"), "number")
    return rows.where(filters.in_scope(("org/r1", "org/r3"), datetime(1999, 6, 1, tzinfo=UTC), (3, 7, 2001))).select("number", "source_type", "source_id", "chunk_index")


@query("select number, source_type, source_id, chunk_index from h_documents where created_at >= timestamp '1997-01-01' and created_at < timestamp '1998-01-01' and trust in ('authoritative', 'reported')")
def since_before_window(spark: SparkSession, d: str) -> DataFrame:
    q = SearchQuery(since=datetime(1997, 1, 1, tzinfo=UTC), before=datetime(1998, 1, 1, tzinfo=UTC)).checked()
    return filters.admissible(corpus(spark, d), q).select("number", "source_type", "source_id", "chunk_index")


def _filtered(name: str, sql: str, **asked):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return filters.admissible(corpus(spark, d), SearchQuery(**asked).checked()).select("number", "source_type", "source_id", "chunk_index")

    query(f"select number, source_type, source_id, chunk_index from h_documents d where trust in ('authoritative', 'reported') and {sql}", name)(run)


_filtered("label_filter", "number in (select number from h_threads where label in ('1-URGENT', '2-HIGH'))", labels=("1-URGENT", "2-HIGH"))
_filtered("author_filter", "lower(author) in ('u3', 'u44')", authors=("@U3", " u44 ", "u3"))
_filtered("file_suffix_filter", "exists (select 1 from h_files f where f.number = d.number and (path = 'm7.py' or ends_with(path, '/m7.py') or path = 'src/m11.py' or ends_with(path, '/src/m11.py')))", files=("./m7.py", "src/m11.py"))
_filtered("symbol_filter", "exists (select 1 from h_symbols f where f.number = d.number and symbol in ('mod_3.run', 'mod_17.run'))", symbols=("mod_3.run", "mod_17.run"))
_filtered("test_filter", "exists (select 1 from h_tests f where f.number = d.number and test_id = 'tests/test_m.py::test_4[p1]')", tests=("tests/test_m.py::test_4[p1]",))
_filtered(
    "error_filter",
    "exists (select 1 from h_error_text e where e.number = d.number and contains(lower(regexp_replace(replace(body, 'ValueError: ', ''), '[0-9]+', '<n>', 'g')), 'expected <n> features, got <n> on cuda'))",
    errors=("ValueError: expected 768 features, got 1024 on cuda",),
)


@query(
    """select number, source_type, source_id, chunk_index from h_documents d where trust in ('authoritative', 'reported')
and exists (select 1 from h_error_text e where e.number = d.number and contains(lower(regexp_replace(replace(body, 'ValueError: ', ''), '[0-9]+', '<n>', 'g')), 'expected <n> features, got <n> on cuda'))
and exists (select 1 from h_files f where f.number = d.number and (path = 'm7.py' or ends_with(path, '/m7.py') or path = 'src/m11.py' or ends_with(path, '/src/m11.py')))"""
)
def indexed_filters(spark: SparkSession, d: str) -> DataFrame:
    """The error and file filters by way of their indexes, which the query builds first."""
    c, folder = corpus(spark, d), f"{shared_folder(spark)}/indexes/{uuid.uuid4().hex}"
    c = replace(c, error_grams=substrings.Trigrams.build(c.errors, f"{folder}/error_grams", c.key, "message_norm"), tails=substrings.PathTails.build(c.files, f"{folder}/tails"))
    q = SearchQuery(errors=("ValueError: expected 768 features, got 1024 on cuda",), files=("./m7.py", "src/m11.py")).checked()
    return filters.admissible(c, q).select("number", "source_type", "source_id", "chunk_index")


@query(
    """select count(distinct d.number) as files_untested from h_documents d join h_threads t using (number) where trust in ('authoritative', 'reported') and thread_type = 'pr'
and not exists (select 1 from h_files f where f.number = d.number and source = 'changed')"""
)
def files_blind_spot(spark: SparkSession, d: str) -> DataFrame:
    return filters.untested_by_files(corpus(spark, d), SearchQuery(files=("m1.py",)).checked())


@query(
    """select number, round((max(case when symbol = 'mod_1.run' then 1 else 0 end) + max(case when symbol = 'mod_2.run' then 1 else 0 end) + max(case when symbol = 'mod_3.run' then 1 else 0 end)) / 3.0, 6) as overlap
from h_symbols where symbol in ('mod_1.run', 'mod_2.run', 'mod_3.run') group by number"""
)
def signal_overlap_score(spark: SparkSession, d: str) -> DataFrame:
    return ranking.overlap(view(spark, d, "h_symbols"), ["number"], F.col("symbol"), ["mod_1.run", "mod_2.run", "mod_3.run"]).select("number", F.round("overlap", 6).alias("overlap"))


@query(
    """select number, chunk_index, source_id, l_suppkey, case when age <= 0 then 1.0 else round(1.0 / (1.0 + age / 548.0), 6) end as failure, case when age <= 0 then 1.0 else round(1.0 / (1.0 + age / 1461.0), 6) end as precedent, 1.0 as rationale
from (select *, cast(date_diff('day', created_at, timestamp '2001-01-01') as double) as age from h_documents)"""
)
def decay_score(spark: SparkSession, d: str) -> DataFrame:
    age = F.datediff(F.lit("2001-01-01").cast("timestamp"), "created_at").cast("double")
    return view(spark, d, "h_documents").select("number", "chunk_index", "source_id", "l_suppkey", *(F.round(decay(age, k), 6).alias(k) for k in ("failure", "precedent", "rationale")))


# -- full text over the test documents; the SQL and the plan cut words in the same ASCII way --------------------------------

_TOKENS = "t as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as term from documents)"
_COUNTS = f"{_TOKENS}, c as (select doc_id, term, count(*) as tf from t group by all), l as (select doc_id, sum(tf) as doc_len from c group by 1), s as (select count(*) as n, avg(doc_len) as m from l)"
_ASKED = ("then", "thand", "within", "ofand")


def _bm25_sql(terms: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return (
        f"with {_COUNTS}, q as (select * from c where term in ({listed})), f as (select term, count(*) as df from q group by 1), "
        "b as (select doc_id, count(*) as matched, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / m))) as score from q join f using (term) join l using (doc_id), s group by 1) "
    )


def ascii_words(text):
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1))


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.postings(table(spark, d, "documents"), analyzer=ascii_words)


_INDEXES: dict[tuple[str, str], fulltext.Index] = {}


def index_of(spark: SparkSession, d: str) -> fulltext.Index:
    """The index of a folder's documents, written once a session: what ingest leaves, which searches read."""
    known = (spark.sparkContext.applicationId, d)
    if known not in _INDEXES:
        _INDEXES[known] = fulltext.Index.build(_postings(spark, d), f"{shared_folder(spark)}/indexes/{uuid.uuid4().hex}")
    return _INDEXES[known]


@query(f"with {_COUNTS} select n, cast(round(m * 1000) as bigint) as mean_len_1000 from s")
def fts_build_index(spark: SparkSession, d: str) -> DataFrame:
    """Writes the index of the documents (at most once a session) and gives its totals."""
    return index_of(spark, d).total().select("n", F.round(F.col("mean_len") * 1000).cast("long").alias("mean_len_1000"))


@query(f"with {_TOKENS} select doc_id, term, count(*) as tf from t group by all")
def fts_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _postings(spark, d).select("doc_id", "term", "tf")


@query(f"with {_TOKENS} select term, count(distinct doc_id) as df from t group by 1")
def fts_df(spark: SparkSession, d: str) -> DataFrame:
    return _postings(spark, d).groupBy("term").agg(F.count("*").alias("df"))


@query(_bm25_sql(_ASKED) + "select doc_id, matched, round(score, 6) as score from b")
def fts_bm25(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.bm25(index_of(spark, d), _ASKED, "any").select("doc_id", "matched", F.round("score", 6).alias("score"))


@query(_bm25_sql(("the", "and")) + "select doc_id, matched, round(score, 6) as score from b where matched = 2")
def fts_match_all(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.bm25(index_of(spark, d), ("the", "and"), "all").select("doc_id", "matched", F.round("score", 6).alias("score"))


@query(f"with {_TOKENS} select distinct doc_id from t where term in ('then', 'thand', 'within', 'ofand')")
def fts_match_any(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.bm25(index_of(spark, d), _ASKED, "any").select("doc_id")


@query(_bm25_sql(_ASKED) + "select doc_id, round(matched / 4.0 + (score / (score + 1)) / 5, 6) as score from b")
def fts_coverage(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.coverage(fulltext.bm25(index_of(spark, d), _ASKED, "any"), 4).select("doc_id", F.round("score", 6).alias("score"))


@query(
    _bm25_sql(("zzyzx", "then", "thand"))
    + ", strict as (select * from b where matched = 3), w as (select doc_id, round(matched / 3.0 + (score / (score + 1)) / 4, 6) as score, true as widened from b where (select count(*) from strict) = 0 "
    "union all select doc_id, round(score, 6), false from strict) select * from w"
)
def widened_search(spark: SparkSession, d: str) -> DataFrame:
    terms, found = ("zzyzx", "then", "thand"), index_of(spark, d)
    strict = fulltext.bm25(found, terms, "all")
    if not strict.isEmpty():
        return strict.select("doc_id", F.round("score", 6).alias("score"), F.lit(False).alias("widened"))
    return fulltext.coverage(fulltext.bm25(found, terms, "any"), 3).select("doc_id", F.round("score", 6).alias("score"), F.lit(True).alias("widened"))


# -- positions: cover density, and an index that grows by batches ----------------------------------------------------------

_PLACES = (
    "t as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as term, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9_]+'), 1) as p from documents), "
    "q as (select doc_id, term, p from t where term in ({terms}))"
)
_NEAR = ("the", "and", "in")


def _positions(spark: SparkSession, d: str) -> DataFrame:
    return segments.positional(table(spark, d, "documents"), "doc_id", "text", analyzer=ascii_words)


@query(
    "with " + _PLACES.format(terms="'the', 'and', 'in'")
    + """, seen as (select doc_id, p, row_number() over run as i, max(case when term = 'the' then p end) over run as a, max(case when term = 'and' then p end) over run as b, max(case when term = 'in' then p end) over run as c
  from q window run as (partition by doc_id order by p rows between unbounded preceding and current row)),
ends as (select doc_id, p, i, least(a, b, c) as s from seen where a is not null and b is not null and c is not null),
covers as (select doc_id, p, i, s from ends qualify lag(s) over (partition by doc_id order by p) is null or s <> lag(s) over (partition by doc_id order by p))
select c.doc_id, cast(3 as bigint) as matched, round(sum(0.1 / (1 + (c.p - c.s) - (c.i - b.i))), 6) as score from covers c join seen b on b.doc_id = c.doc_id and b.p = c.s group by 1"""
)
def fts_cover_density_all(spark: SparkSession, d: str) -> DataFrame:
    return segments.cover_density(_positions(spark, d), _NEAR, "all").select("doc_id", "matched", F.round("score", 6).alias("score"))


@query(
    "with " + _PLACES.format(terms="'then', 'thand', 'within', 'ofand'")
    + """, o as (select doc_id, count(distinct term) as matched, 0.1 * count(*) as r from q group by 1) select doc_id, matched, round(matched / 4.0 + (r / (r + 1)) / 5, 6) as score from o"""
)
def fts_cover_density_any(spark: SparkSession, d: str) -> DataFrame:
    return segments.widened_density(_positions(spark, d), _ASKED).select("doc_id", "matched", F.round("score", 6).alias("score"))


def _batches(spark: SparkSession, d: str) -> list[tuple[DataFrame, object]]:
    """The documents in three batches: most of them; edits (texts reversed by words) and new ones; deletions and edits again."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    backwards = F.array_join(F.reverse(ascii_words(F.col("text"))), " ")
    third = F.col("doc_id") % 3
    return [
        (docs.where(third < 2), None),
        (docs.where((third == 2) | (F.col("doc_id") % 5 == 0)).withColumn("text", F.when(third == 2, F.col("text")).otherwise(backwards)), None),
        (docs.where(F.col("doc_id") % 7 == 0).withColumn("gone", F.col("doc_id") % 2 == 0), F.col("gone")),
    ]


@query(
    """with v as (select doc_id, text, doc_id % 7 = 0 and doc_id % 2 = 0 as gone, doc_id % 7 <> 0 and doc_id % 5 = 0 and doc_id % 3 < 2 as turned from documents),
w as (select doc_id, turned, regexp_extract_all(lower(text), '[a-z0-9_]+') as words from v where not gone and text is not null),
t as (select doc_id, len(words) as doc_len, unnest(words) as term, generate_subscripts(words, 1) as i, turned from w),
s as (select count(distinct doc_id) as n, count(*) * 1.0 / count(distinct doc_id) as m from t),
q as (select doc_id, term, count(*) as tf, any_value(doc_len) as doc_len, min(case when turned then doc_len - i else i - 1 end) as first_place from t where term in ('then', 'thand', 'within', 'ofand') group by 1, 2),
f as (select term, count(*) as df from q group by 1)
select doc_id, term, tf, df, cast(first_place as bigint) as first_place, n, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / m)), 6) as score from q join f using (term), s"""
)
def fts_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Postings and scores of an index that three batches with edits and deletes left, the oldest two of its segments merged."""
    index = segments.Segments(spark, f"{shared_folder(spark)}/indexes/{uuid.uuid4().hex}")
    for batch, gone in _batches(spark, d):
        index.append(batch, gone=gone, analyzer=ascii_words)
    index.merged(index.segments()[:2])
    found = index.postings(_ASKED).join(F.broadcast(index.frequencies(_ASKED)), "term").join(F.broadcast(index.total()))  # a row a term asked; one row
    score = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("doc_len") / F.col("mean_len")))
    return found.select("doc_id", "term", "tf", "df", F.get("positions", F.lit(0)).cast("long").alias("first_place"), "n", F.round(score, 6).alias("score"))


@query(
    """w as (select number, comment, list_filter(string_split(regexp_replace(lower(body), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') as words from h_posts)
select number, comment from w where list_contains(words, 'config') and list_contains(words, '4')""".replace("\\\\", "\\")
)
def search_identifier(spark: SparkSession, d: str) -> DataFrame:
    """A question for an identifier meets the postings as the same analysis cuts both."""
    posts = view(spark, d, "h_posts").withColumn("doc_key", F.struct("number", "comment"))
    found = fulltext.postings(posts, "doc_key", "body")
    return fulltext.bm25(found, fulltext.asked_words("Config_4"), "all", "doc_key").select("doc_key.*")


@query(
    f"""x as (select d.*, 'file' as leg, 0 as leg_order, row_number() over (order by {SQL_ORDER}) as rank from h_documents d where exists (select 1 from h_files f where f.number = d.number and path = 'src/m5.py' and source = 'changed')),
y as (select d.*, 'symbol' as leg, 1 as leg_order, row_number() over (order by {SQL_ORDER}) as rank from h_documents d where exists (select 1 from h_symbols f where f.number = d.number and symbol = 'mod_8.run')),
z as (select * from x union all select * from y),
g as (select number, source_type, sum(1.0 / (60 + rank)) as score, arg_min(leg, leg_order * 1000000000 + rank) as leg, min(leg_order) as leg_order, arg_min(source_id, leg_order * 1000000000 + rank) as source_id from z group by 1, 2),
r as (select *, row_number() over (partition by number order by score desc, leg_order, number, source_type) as n from g)
select number, source_type, leg, source_id, round(score, 9) as score from r where n <= 3 order by score desc, leg_order, number, source_type limit 10"""
)
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    docs, n = dealt(spark, d, "h_documents"), parts(spark, d, "lineitem")
    f = dealt(spark, d, "h_files").where("path = 'src/m5.py' and source = 'changed'").select("number").distinct()
    s = dealt(spark, d, "h_symbols").where("symbol = 'mod_8.run'").select("number").distinct()
    legs = docs.join(f, "number", "left_semi").withColumns({"leg": F.lit("file"), "leg_order": F.lit(0)}).unionByName(docs.join(s, "number", "left_semi").withColumns({"leg": F.lit("symbol"), "leg_order": F.lit(1)}))
    from threadloom.operators.evaluation import ranked_by_day

    rows = ranked_by_day(legs, ["leg_order"], F.col("created_at").cast("date"), [F.col("created_at").desc_nulls_last(), *ties()], n).repartition(n, "number")
    return ranking.fused(rows, ["number"]).select("number", "source_type", "leg", "source_id", F.round("score", 9).alias("score"))


@query(
    f"""p as (select *, case trust when 'authoritative' then 2.0 when 'reported' then 1.0 else 0.0 end as score from h_documents),
a as (select *, row_number() over (partition by number, source_type order by score desc, {SQL_ORDER}) as n1 from p),
b as (select *, row_number() over (partition by number order by score desc, {SQL_ORDER}) as n2 from a where n1 = 1),
c as (select * from b where n2 <= 3 order by score desc, {SQL_ORDER} limit 10)
select number, source_type, source_id, strftime(created_at, '%Y-%m-%d') as created, row_number() over (order by {SQL_ORDER}) as place from c"""
)
def sort_newest(spark: SparkSession, d: str) -> DataFrame:
    from threadloom.operators.evaluation import ranked

    rows = view(spark, d, "h_documents").withColumn("score", F.when(F.col("trust") == "authoritative", 2.0).when(F.col("trust") == "reported", 1.0).otherwise(0.0))
    page = ranking.presented(ranking.select_page(rows, ["number"], ties()), "newest", ties())
    return ranked(page, [], [F.col("created_at").desc_nulls_last(), *ties()]).select("number", "source_type", "source_id", F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.col("rank").cast("long").alias("place"))
