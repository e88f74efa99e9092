"""Full-text search over a postings table: built once, pruned by term, scored in one join and one aggregation."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import TYPE_CHECKING
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from threadloom.functions.porter import stem
from threadloom.schemas import BM25_B, BM25_K1, ENGLISH_STOPWORDS, MAX_ANY_TERMS

if TYPE_CHECKING:
    from threadloom.operators.segments import Segments

#: Parts of a bucket of terms, so that a frequent term is no single task and a bucket no more files than this.
DEALT = 16


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def english(text: Column) -> Column:
    """The words that the English analysis keeps; postings stem them."""
    return F.filter(words(text), lambda w: ~w.isin(*ENGLISH_STOPWORDS))


def asked_words(question: str) -> list[str]:
    """The terms of a question, cut as `words` cuts texts."""
    return re.findall(r"[^\W_]+", question.lower())


def asked_english(question: str) -> list[str]:
    """The terms of a question for postings of `english` words with stemming."""
    return [stem(w) for w in asked_words(question) if w not in ENGLISH_STOPWORDS]


@F.pandas_udf(StringType())
def stemmed(terms: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[str, str] = {}
    for series in terms:
        for w in series.unique():
            if w not in known:
                if len(known) > 200_000:
                    known.clear()
                known[w] = stem(w)
        yield series.map(lambda w: known.get(w) or stem(w))


def postings(documents: DataFrame, key: str = "doc_id", text: str = "text", stemming: bool = False, analyzer=words, only: DataFrame | None = None) -> DataFrame:
    """(key, term, tf, doc_len). With stemming, terms are stemmed once each, after counting. Texts are dealt by their key and not their words after
    the cut: all counts of a key are in one place then. only: (term), distinct; other words are left out before they are counted, and each document with
    words has a posting of the empty term besides."""
    cut = documents.select(key, text).repartition(key).select(key, analyzer(F.coalesce(F.col(text), F.lit(""))).alias("words_"))
    tokens = cut.select(key, F.size("words_").cast("long").alias("doc_len"), F.explode("words_").alias("term"))
    if only is not None:
        marked = F.explode(F.when(F.size("words_") > 0, F.concat("words_", F.array(F.lit("")))))
        tokens = cut.select(key, F.size("words_").cast("long").alias("doc_len"), marked.alias("term"))
        asked = only.select("term").unionByName(only.sparkSession.range(1).select(F.lit("").alias("term")))
        tokens = tokens.join(F.broadcast(asked), "term", "left_semi")  # a row a term asked
    counted = tokens.groupBy(key, "term").agg(F.count("*").alias("tf"), F.any_value("doc_len").alias("doc_len"))
    if stemming:
        counted = counted.withColumn("term", stemmed("term")).groupBy(key, "term").agg(F.sum("tf").alias("tf"), F.any_value("doc_len").alias("doc_len"))
    return counted


@dataclass(frozen=True)
class Index:
    """Postings that were written once, by bucket of the term and sorted by term, with their totals next to them.

    A question reads the row groups of its own terms in their buckets, and a one-row table of totals.
    """

    spark: SparkSession
    path: str
    buckets: int = 64

    @staticmethod
    def build(found: DataFrame, path: str, key: str = "doc_id", buckets: int = 64) -> Index:
        path, spark = path.rstrip("/"), found.sparkSession
        by = (F.crc32(F.col("term").cast("binary")) % buckets).cast("int")
        found.withColumn("term_bucket", by).repartition("term_bucket", F.pmod(F.xxhash64(key), F.lit(DEALT))).sortWithinPartitions("term_bucket", "term").write.partitionBy("term_bucket").mode("overwrite").parquet(f"{path}/postings")
        totals(spark.read.parquet(f"{path}/postings"), key).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
        return Index(spark, path, buckets)

    def postings(self, terms: Sequence[str]) -> DataFrame:
        found = self.spark.read.parquet(f"{self.path}/postings")
        buckets = sorted({crc32(t.encode()) % self.buckets for t in terms})
        return found.where(F.col("term_bucket").isin(buckets) & F.col("term").isin(list(terms))) if terms else found.where(F.lit(False))

    def total(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/totals")


def totals(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: the number of documents and their mean length."""
    return found.groupBy(key).agg(F.max("doc_len").alias("doc_len")).agg(F.count("*").alias("n"), F.avg("doc_len").alias("mean_len"))


def bm25(found: DataFrame | Index | Segments, terms: Sequence[str], match: str = "all", key: str = "doc_id", total: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(key, matched, score) of the documents with all the terms, or any of the first MAX_ANY_TERMS. found: postings, or an
    index of them. keep: columns of the postings that tell of the document.

    score is BM25 with idf = ln(1 + (N - df + 0.5) / (df + 0.5)). A question without terms matches nothing.
    """
    asked = list(dict.fromkeys(terms))[: None if match == "all" else MAX_ANY_TERMS]
    df = None
    if not isinstance(found, DataFrame):
        df = None if isinstance(found, Index) else found.frequencies(asked)
        total, found = total if total is not None else found.total(), found.postings(asked)
    mine = found.where(F.col("term").isin(*asked) if asked else F.lit(False))
    df = F.broadcast(df if df is not None else mine.groupBy("term").agg(F.count("*").alias("df")))  # a row a term asked
    one = F.broadcast(total if total is not None else totals(found, key))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("doc_len") / F.col("mean_len")))
    scored = mine.join(df, "term").join(one).groupBy(key).agg(F.count("*").alias("matched"), F.sum(part).alias("score"), *(F.any_value(F.col(c)).alias(c) for c in keep))
    return scored.where(F.col("matched") == len(asked)) if match == "all" else scored


def coverage(scored: DataFrame, asked: int) -> DataFrame:
    """The widened score: the share of terms first, density as the tie-break below one term's worth."""
    return scored.withColumn("score", F.col("matched") / asked + (F.col("score") / (F.col("score") + 1)) / (asked + 1))
