"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A window of an item is a set of five-word shingles. A text that holds the window holds all of them, so at full
containment one shingle, the rarest over all documents, is the necessary prefix. Documents are joined on that shingle's
hash alone; the shingle's place in the window fixes where the window would start (positional bound) and end (length
bound); the words there are then compared one by one. A window with a shingle that no document has is never joined.

Texts are cut into words once; from there on a word is its 64-bit hash, and two windows are equal when all their words'
hashes are. A bit filter of bounded size keeps positions without an item's shingle from being shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import ascii_lower, maybe_in, staged

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 5


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingle(hashes: Column, at: Column, k: int) -> Column:
    """The hash of the k words from 0-based `at` on; null if there are fewer."""
    return F.when(at + k <= F.size(hashes), F.xxhash64(F.lit(k), *(F.get(hashes, at + i) for i in range(k))))


def item_windows(items: DataFrame, window: int, text: str, key: str) -> DataFrame:
    """(item_id, wid, size, hashes): the windows of every item with words."""
    one = items.select(F.col(key).cast("string").alias("item_id"), words_of(F.col(text)).alias("all")).where("size(all) > 0")
    one = one.withColumn("size", F.least(F.size("all"), F.lit(window)))
    one = one.select("item_id", "size", "all", F.explode(F.sequence(F.lit(1), F.size("all") - F.col("size") + 1)).alias("first"))
    one = one.select("item_id", "size", F.slice("all", F.col("first"), F.col("size")).alias("words"))
    return one.select("item_id", F.sha2(F.array_join("words", " ").cast("binary"), 256).alias("wid"), "size", _hashes(F.col("words")).alias("hashes")).distinct()


def _positions(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, of, n_words, hashes, at, h): the shingles of each length at every word of the texts."""
    placed = texts.select("doc_id", "of", "n_words", "hashes", F.posexplode("hashes").alias("at", "word"))
    found = [_shingle(F.col("hashes"), F.col("at"), k) for k in lengths] or [F.lit(None).cast("long")]
    one = found[0] if len(found) == 1 else F.explode(F.array(*found))
    return placed.select("doc_id", "of", "n_words", "hashes", "at", one.alias("h")).where("h is not null")


def contamination(documents: DataFrame, items: DataFrame, window: int = 13, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """One row for each (doc_id, text): doc_id, n_words, n_hit, n_items, items, contaminated.

    A word is hit when it lies inside an occurrence of a window: `window` consecutive words of an item, or the whole item
    if it is shorter. Null or wordless texts have no words, no hits and are clean; such items have no windows. Rows that
    repeat both doc_id and text give one row; rows that repeat a doc_id with another text give one each; a null doc_id is
    kept. Repeated items count once, null item ids not at all. Empty tables give empty results or clean documents.
    """
    windows = staged(item_windows(items.where(F.col(item_key).isNotNull()), window, item_text, item_key), "decontam-windows")
    distinct = windows.select("wid", "size", "hashes").distinct()
    k = F.least(F.lit(SHINGLE), F.col("size"))
    shingled = distinct.select("wid", "size", "hashes", k.alias("k"), F.explode(F.sequence(F.lit(0), F.col("size") - k)).alias("offset"))
    hash_of = reduce(lambda rest, n: F.when(F.col("k") == n, _shingle(F.col("hashes"), F.col("offset"), n)).otherwise(rest), range(1, SHINGLE + 1), F.lit(None).cast("long"))
    shingled = staged(shingled.withColumn("h", hash_of), "decontam-shingles")
    lengths = sorted(r["k"] for r in shingled.select("k").distinct().collect())  # SHINGLE values at most

    texts = documents.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("of"), _hashes(words_of(F.col(text))).alias("hashes"))
    texts = staged(texts.select("doc_id", "of", F.size("hashes").cast("long").alias("n_words"), "hashes"), "decontam-words")
    placed = _positions(texts, lengths)

    counts = maybe_in(placed.select("h"), ["h"], shingled.select("h").distinct()).groupBy("h").agg(F.count("*").alias("count"))
    ranked = shingled.join(counts, "h").groupBy("wid").agg(F.count("*").alias("present"), F.min_by(F.struct("h", "offset", "size", "k", "hashes"), F.struct("count", "offset")).alias("rarest"))
    ranked = ranked.where(F.col("present") == F.col("rarest.size") - F.col("rarest.k") + 1)
    prefixes = staged(ranked.select("wid", "rarest.h", "rarest.offset", "rarest.size", F.col("rarest.hashes").alias("window")), "decontam-prefixes")

    # the words around a shingle hold every window that it may be the prefix of
    before = F.least(F.col("at"), F.lit(window))
    near = F.slice("hashes", F.col("at") - before + 1, before + window)
    met = maybe_in(placed, ["h"], prefixes.select("h").distinct()).select("doc_id", "of", "n_words", "at", "h", before.alias("before"), near.alias("near")).join(prefixes, "h")
    start = F.col("at") - F.col("offset")
    holds = (start >= 0) & (start + F.col("size") <= F.col("n_words")) & (F.slice("near", F.greatest(F.col("before") - F.col("offset"), F.lit(0)) + 1, F.col("size")) == F.col("window"))
    hits = met.where(holds).groupBy("doc_id", "of").agg(F.collect_set(F.struct(start.alias("start"), (start + F.col("size")).alias("end"), "wid")).alias("hits"))
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("of").alias("hit_of"), "hits")
    by_text = texts.groupBy("doc_id", "of").agg(F.max("n_words").alias("n_words")).join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("of") == F.col("hit_of")), "left")
    by_text = staged(by_text.select("doc_id", "of", "n_words", F.coalesce("hits", F.array().cast("array<struct<start:int,end:int,wid:string>>")).alias("hits")), "decontam-hits")

    spans = F.array_sort(F.array_distinct(F.transform("hits", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))))
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    covered = F.aggregate(spans, nothing, lambda s, x: F.struct((s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["upto"]), F.lit(0))).alias("n"), F.greatest(s["upto"], x["end"]).alias("upto")), lambda s: s["n"])
    pairs = by_text.where("size(hits) > 0").select("doc_id", "of", F.explode(F.array_distinct(F.transform("hits", lambda x: x["wid"]))).alias("wid"))
    found = pairs.join(windows.select("wid", "item_id"), "wid").groupBy("doc_id", "of").agg(F.array_sort(F.collect_set("item_id")).alias("items")).select(F.col("doc_id").alias("id"), F.col("of").alias("of_"), "items")
    out = by_text.withColumn("n_hit", covered).join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("of") == F.col("of_")), "left")
    out = out.withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select("doc_id", F.col("of").alias("text_hash"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
w as (select distinct item_id, least(len(words), 13) as size, array_to_string(words[s : s + least(len(words), 13) - 1], ' ') as win
  from i, unnest(range(1, len(words) - least(len(words), 13) + 2)) t(s) where len(words) > 0),
sizes as (select distinct size from w),
p as (select doc_id, len(words) as n, size, s, array_to_string(words[s : s + size - 1], ' ') as win
  from d, sizes, unnest(range(1, greatest(len(words) - size + 2, 1))) t(s)),
h as (select p.doc_id, p.s, p.size, w.item_id from p join w on p.size = w.size and p.win = w.win),
hw as (select distinct doc_id, unnest(range(s, s + size)) as at from h),
nh as (select doc_id, count(*) as n_hit from hw group by 1),
it as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, cast(item_id as varchar) as item_id from h) group by 1)
select d.doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from d left join nh using (doc_id) left join it using (doc_id)
"""
