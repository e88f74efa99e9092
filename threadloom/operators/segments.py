"""A full-text index in immutable segments: positions and facets in the postings, edits and deletes by later segments.

Each batch writes one segment and never touches an older one. A segment holds postings (sorted by term in buckets of it), its documents with their
terms, the keys that it retires, and what it adds to and takes from document counts and totals. A posting counts unless a
later segment retired its key. `merged` rewrites the oldest segments as one. A segment is visible once its one-row table of
totals is there, which is written last; a batch that dies half way leaves nothing that a reader would see.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from zlib import crc32

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import named
from threadloom.operators.fulltext import DEALT, stemmed, words

BUCKETS = 64
_PARTS = ("postings", "documents", "retired", "frequencies", "totals")


def bucket_of(term: Column) -> Column:
    return (F.crc32(term.cast("binary")) % BUCKETS).cast("int")


def placed(documents: DataFrame, key: str, text: str, facets: Sequence[str] = (), analyzer: Callable[[Column], Column] = words, stopwords: Sequence[str] = ()) -> DataFrame:
    """(key, doc_len, facets..., entries): a row a key, with each of its terms and where it stands. A document without terms has no row.

    Texts are dealt and not their words, and a document's words are sorted in its own row: nothing is grouped by word.
    """
    kept = lambda w: ~w.isin(*stopwords)
    mine = documents.select(key, *facets, F.coalesce(F.col(text), F.lit("")).alias("text_")).repartition(key).groupBy(key)
    mine = mine.agg(F.collect_list("text_").alias("texts_"), *(F.any_value(F.col(c)).alias(c) for c in facets))  # rows that share a key are one document
    at = lambda t: F.transform(analyzer(t), lambda w, i: F.struct(w.alias("term"), i.alias("at")))
    every = F.flatten(F.transform("texts_", at))
    line = F.sort_array(F.filter(every, lambda x: kept(x["term"])) if stopwords else every)
    first = lambda line: F.filter(F.sequence(F.lit(0), F.size(line) - 1), lambda i: (i == 0) | (F.get(line, i)["term"] != F.get(line, i - 1)["term"]))

    def runs(line: Column) -> Column:
        def run(starts: Column) -> Column:
            end = lambda j: F.coalesce(F.get(starts, j + 1), F.size(line))
            return F.transform(starts, lambda a, j: F.struct(F.get(line, a)["term"].alias("term"), F.transform(F.slice(line, a + 1, end(j) - a), lambda x: x["at"]).alias("positions")))

        return F.when(F.size(line) > 0, F.struct(F.size(line).cast("long").alias("doc_len"), named(first(line), run).alias("entries")))

    found = mine.select(key, *facets, F.explode(F.array(named(line, runs))).alias("d")).where("d is not null")
    return found.select(key, "d.doc_len", *facets, "d.entries")


def positional(documents: DataFrame, key: str, text: str, facets: Sequence[str] = (), analyzer: Callable[[Column], Column] = words, stopwords: Sequence[str] = (), stemming: bool = False) -> DataFrame:
    """(key, term, tf, positions, doc_len, facets...): where each term of a document stands.

    Positions are counted over all words; stopwords have no postings but keep their places, so that nearness means the same
    with and without them. A document without terms has no row. doc_len is the number of words that are kept.
    """
    return _postings(placed(documents, key, text, facets, analyzer, stopwords), key, facets, stemming)


def _postings(found: DataFrame, key: str, more: Sequence[str], stemming: bool) -> DataFrame:
    each = found.select(key, "doc_len", *more, F.inline("entries"))
    if stemming:
        every = (F.any_value(F.col(c)).alias(c) for c in ("doc_len", *more))
        each = each.withColumn("term", stemmed("term")).groupBy(key, "term").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"), *every)
    return each.select(key, "term", F.size("positions").cast("long").alias("tf"), "positions", "doc_len", *more)


@dataclass(frozen=True)
class Segments:
    """The index in a folder. key is the column that tells documents apart."""

    spark: SparkSession
    path: str
    key: str = "doc_id"

    def _read(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path.rstrip('/')}/{part}")

    def _totals(self) -> DataFrame | None:
        try:
            return self._read("totals")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def segments(self) -> list[int]:
        """The segments that count: those written to the end and not merged into another. A row a batch since the last merge."""
        totals = self._totals()
        rows = totals.select("segment", "replaces").collect() if totals is not None else []
        gone = {s for r in rows for s in r["replaces"]}
        return sorted(r["segment"] for r in rows if r["segment"] not in gone)

    def part(self, name: str, segments: Sequence[int] | None = None) -> DataFrame:
        return self._read(name).where(F.col("segment").isin(self.segments() if segments is None else list(segments)))

    # -- writing ------------------------------------------------------------------------------------------------------

    def _write(self, segment: int, part: str, rows: DataFrame, by: str | None = None) -> None:
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.path.rstrip('/')}/{part}/segment={segment}")

    def _commit(self, segment: int, postings: DataFrame, documents: DataFrame, retired: DataFrame, replaces: Sequence[int] = ()) -> int:
        """postings and documents (key, age, doc_len, terms) have an age: the segment that first wrote this version of the document. retired: such
        rows of other segments that no longer count."""
        self._write(segment, "postings", postings.withColumn("term_bucket", bucket_of(F.col("term"))).repartition("term_bucket", F.pmod(F.xxhash64(self.key), F.lit(DEALT))).sortWithinPartitions("term_bucket", "term", self.key), "term_bucket")
        self._write(segment, "documents", documents.select(self.key, "age", "doc_len", "terms"))
        self._write(segment, "retired", retired.select(self.key, F.lit(segment).alias("by")))
        docs = self._read(f"documents/segment={segment}").select("doc_len", "terms", F.lit(1).cast("long").alias("sign"))
        if replaces:  # what is merged away takes its own differences with it
            change = docs
        else:
            change = docs.unionByName(retired.select("doc_len", "terms", F.lit(-1).cast("long").alias("sign")))
        df = change.select("sign", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("sign").alias("df")).where("df <> 0")
        self._write(segment, "frequencies", df.sort("term"))
        one = change.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("sign") * F.col("doc_len")), F.lit(0)).alias("words"))
        self._write(segment, "totals", one.withColumn("replaces", F.lit(list(replaces)).cast("array<int>")).coalesce(1))
        return segment

    def append(self, batch: DataFrame, text: str = "text", facets: Sequence[str] = (), gone: Column | None = None, **analysis: object) -> int:
        """Index a batch: one row a key, new, edited or, where gone says so, deleted. Returns the segment's number.

        What is written follows the batch. The keys of older segments are read to find what the batch retires.
        """
        there = self.segments()
        totals = self._totals()
        segment = (totals.agg(F.max("segment")).first()[0] + 1) if there else 0
        gone = F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)
        stemming = analysis.pop("stemming", False)
        cut = placed(batch.where(~gone), self.key, text, facets, **analysis).withColumn("age", F.lit(segment)).persist(StorageLevel.DISK_ONLY)  # texts are cut once for postings and documents
        found = _postings(cut, self.key, (*facets, "age"), stemming)
        if stemming:
            known = found.groupBy(self.key).agg(F.any_value("age").alias("age"), F.any_value("doc_len").alias("doc_len"), F.collect_list("term").alias("terms"))
        else:
            known = cut.select(self.key, "age", "doc_len", F.col("entries.term").alias("terms"))
        if there:
            retired = self.alive("documents", there).join(batch.select(self.key).distinct(), self.key, "left_semi").select(self.key, "age", "doc_len", "terms")
        else:
            retired = known.where("false")
        try:
            return self._commit(segment, found, known, retired)
        finally:
            cut.unpersist()

    def merged(self, segments: Sequence[int] | None = None) -> int:
        """Rewrite the oldest segments (all, unless named) as one, without what was retired among them."""
        there = self.segments()
        chosen = there if segments is None else sorted(segments)
        if chosen != there[: len(chosen)]:
            raise ValueError("only the oldest segments can be merged: younger ones retire their documents")
        new = self._totals().agg(F.max("segment")).first()[0] + 1
        kept = self.alive("postings", chosen, chosen).drop("segment", "term_bucket")
        known = self.alive("documents", chosen, chosen).select(self.key, "age", "doc_len", "terms")
        return self._commit(new, kept, known, known.where("false"), chosen)

    # -- reading ------------------------------------------------------------------------------------------------------

    def alive(self, part: str, segments: Sequence[int] | None = None, retiring: Sequence[int] | None = None, only: Column | None = None) -> DataFrame:
        """Rows of a part that no later segment retired. only: which rows are wanted at all."""
        segments = self.segments() if segments is None else segments
        rows = (self._read(part) if only is None else self._read(part).where(only)).where(F.col("segment").isin(list(segments)))
        last = self.part("retired", segments if retiring is None else retiring).groupBy(self.key).agg(F.max("by").alias("by"))
        return rows.join(last.withColumnRenamed(self.key, "key_"), (F.col(self.key) == F.col("key_")) & (F.col("age") < F.col("by")), "left_anti")

    def postings(self, terms: Sequence[str]) -> DataFrame:
        """The postings of some terms: their buckets, and in them the row groups of these terms."""
        buckets = sorted({crc32(t.encode()) % BUCKETS for t in terms})
        return self.alive("postings", only=F.col("term_bucket").isin(buckets) & F.col("term").isin(list(terms)) if terms else F.lit(False))

    def frequencies(self, terms: Sequence[str]) -> DataFrame:
        """(term, df) by the differences of all segments."""
        return self.part("frequencies").where(F.col("term").isin(list(terms)) if terms else F.lit(False)).groupBy("term").agg(F.sum("df").alias("df"))

    def total(self) -> DataFrame:
        """One row: documents with terms, and their mean length."""
        return self.part("totals").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).select("n", (F.col("words") / F.col("n")).alias("mean_len"))


# -- cover density ----------------------------------------------------------------------------------------------------

#: The weight of one cover without other words in it (fixed value).
COVER_WEIGHT = 0.1


def cover_density(found: DataFrame, terms: Sequence[str], match: str = "all", key: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """(key, matched, score, keep...) of postings with positions: the nearer the terms stand together, the higher the score.

    With "all", a cover is a shortest stretch that holds every term; it is worth COVER_WEIGHT over one plus the number of other words in it.
    With "any", every occurrence is a cover of its own. A document's few posting lists are merged by position and scanned once, in the JVM:
    the scan keeps each term's last occurrence, and a stretch that ends here is shortest if it begins later than the one before.
    A question without terms matches nothing.
    """
    asked = list(dict.fromkeys(terms))
    mine = found.where(F.col("term").isin(*asked) if asked else F.lit(False))
    more = [F.any_value(F.col(c)).alias(c) for c in keep]
    if match == "any":
        return mine.groupBy(key).agg(F.count("*").alias("matched"), (COVER_WEIGHT * F.sum("tf")).alias("score"), *more)
    place = F.array_position(F.lit(asked) if asked else F.array().cast("array<string>"), F.col("term")).cast("int") - 1
    lists = mine.groupBy(key).agg(F.collect_list(F.transform("positions", lambda p: F.struct(p.alias("p"), place.alias("t")))).alias("lists"), *more)
    rows = lists.where(F.size("lists") == len(asked)).select(key, *keep, F.array_sort(F.flatten("lists")).alias("line"))

    def step(acc: Column, x: Column) -> Column:
        last = F.transform(acc["last"], lambda v, j: F.when(j == x["t"], acc["i"]).otherwise(v))
        start = F.array_min(last)
        others = (x["p"] - F.get(F.col("line"), start)["p"]) - (acc["i"] - start)
        worth = F.when((start >= 0) & (start != acc["start"]), COVER_WEIGHT / (1 + others)).otherwise(0.0)
        return F.struct(last.alias("last"), (acc["i"] + 1).alias("i"), F.when(start >= 0, start).otherwise(acc["start"]).alias("start"), (acc["score"] + worth).alias("score"))

    nothing = F.struct(F.array_repeat(F.lit(-1), len(asked)).alias("last"), F.lit(0).alias("i"), F.lit(-1).alias("start"), F.lit(0.0).alias("score"))
    return rows.select(key, F.lit(len(asked)).cast("long").alias("matched"), F.aggregate("line", nothing, step, lambda acc: acc["score"]).alias("score"), *keep)


def damped(score: Column) -> Column:
    """A score in [0, 1), in the same order."""
    return score / (score + 1)


def widened_density(found: DataFrame, terms: Sequence[str], key: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """(key, matched, score): the share of the terms decides; density, below the worth of one term, breaks ties."""
    asked = len(dict.fromkeys(terms))
    return cover_density(found, terms, "any", key, keep).withColumn("score", F.col("matched") / max(asked, 1) + damped(F.col("score")) / (asked + 1))
