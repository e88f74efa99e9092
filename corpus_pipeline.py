"""The corpus pipeline: each stage works on all that its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import decontam, exact_dedup, langid, minhash, sentencepiece_codec
from threadloom.llm.common import staged, table

#: A text whose leading language has a smaller share than this has no language of its own.
LEAST_SHARE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter (null and empty ones among them) and texts without a leading language go.

    All other rows stay as they are, repeated ones too, with all their columns. An empty table stays empty.
    """
    columns = docs.columns
    found = langid.identified(docs, langid.fit(docs))
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SHARE)).select(*columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the one with the smallest doc_id stays.

    Null text counts as empty; a null doc_id comes after all others. Rows that repeat a doc_id and a text stay once. All columns stay; an empty
    table stays empty.
    """
    return exact_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8), the smallest doc_id stays.

    Texts without words, null ones among them, are linked with nothing and stay, and so do rows without a doc_id. Rows that share a doc_id
    share its fate. All columns stay; an empty table stays empty.
    """
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go.

    Null texts hold nothing and stay. Rows meet their verdict by doc_id, null included, and text, so rows that share an id are judged apart. All
    columns stay; an empty table stays empty, and an empty benchmark lets all rows pass.
    """
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("gone_id"), "text_hash")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["gone_id"]) & (F.xxhash64(docs["text"]) == found["text_hash"]), "left_anti")


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text that is left, checked by decoding them. A row for each row, repeated ones too; null text has no ids."""
    return sentencepiece_codec.round_trip(docs).select("doc_id", "lang", "source", "n_ids", "ids", "decoded_sha256", "exact")


STAGES = [
    ("language id", language_id),
    ("exact dedup", exact_duplicates),
    ("near dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("sentencepiece", tokenised),
]

#: SQL can't express the mixture model, the signatures or the pieces; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
