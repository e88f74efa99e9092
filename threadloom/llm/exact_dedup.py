"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 hashes every text to two cells of a bit filter and keeps the cells that were hit at least twice, as blocks of
32,768 bits. Pass 2 probes each hash: a text whose cells were not both hit twice cannot have a copy, so its row passes
straight through. Only the possibly repeated rows shuffle. The filter has a fixed number of bits, so the blocks that are
broadcast have a proven bound (filter_bits / 8 bytes); beyond that size more rows shuffle, and results stay the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import MOST_FILTER_BITS, bit_blocks, bit_set, cell_of, filter_bits, numbered, spare_name, staged


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _cells(bits: int) -> list[tuple[Column, Column]]:
    """(block, bit within it) of a digest's two cells."""
    return [cell_of(F.xxhash64("text_sha256", F.lit(seed)), bits) for seed in (1, 2)]


def repeat_filter(digests: DataFrame, bits: int) -> DataFrame:
    """(block, longs): the cells that at least two rows hit. Counts combine before the shuffle, so a hot text costs one row a task."""
    cells = F.array(*(F.struct(block.alias("block"), bit.alias("bit")) for block, bit in _cells(bits)))
    hit = digests.select(F.explode(cells).alias("cell")).groupBy("cell.block", "cell.bit").agg(F.count("*").alias("hits")).where("hits > 1")
    return bit_blocks(hit.select("block", "bit"))


def exact_groups(documents: DataFrame, text: str = "text", key: str = "doc_id", salts: int = 64, most_filter_bits: int = MOST_FILTER_BITS) -> DataFrame:
    """One row for each row of documents: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when equal after white space is normalised. Of a group, the row with the smallest doc_id stays.
    Null text is empty text. A null doc_id comes after every other id. Of rows that repeat one doc_id and text, all are
    counted and exactly one is kept. An empty table gives an empty result. Other columns are not read.
    """
    digests = documents.select(F.col(key).cast("long").alias("doc_id"), F.sha2(normalised(F.col(text)).cast("binary"), 256).alias("text_sha256"))
    digests = staged(numbered(digests, "uid"), "exact-digests")
    bits = filter_bits(digests.count(), most_filter_bits)
    blocks = F.broadcast(repeat_filter(digests, bits))
    probed = digests
    for n, (block, bit) in enumerate(_cells(bits)):
        probed = probed.withColumn("block", block).join(blocks, "block", "left").withColumn(f"hit{n}", F.coalesce(bit_set(F.col("longs"), bit), F.lit(False))).drop("block", "longs")
    probed = staged(probed.select("doc_id", "uid", "text_sha256", (F.col("hit0") & F.col("hit1")).alias("maybe")), "exact-probed")

    alone = probed.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = probed.where("maybe").withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int")).drop("maybe")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    by_salt = maybe.groupBy("text_sha256", "salt").agg(F.min(first).alias("first"), F.count("*").alias("n"))
    groups = by_salt.groupBy("text_sha256").agg(F.min("first").alias("first"), F.sum("n").alias("group_size"), F.collect_list("salt").alias("at"))
    groups = groups.select("text_sha256", F.explode("at").alias("salt"), "first", "group_size")
    met = maybe.join(groups, ["text_sha256", "salt"]).select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("first.uid")).alias("kept"), "text_sha256")
    return alone.unionByName(met)


def deduplicated(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of documents that stay, all columns as they were. Rows that repeat a doc_id and a text stay once."""
    found = exact_groups(documents, text, key).where(~F.col("kept"))
    gone = staged(found.select("doc_id", F.col("text_sha256").alias("digest"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("again")).distinct(), "exact-gone")
    digest = F.sha2(normalised(F.col(text)).cast("binary"), 256)
    others = gone.where("not again").select(F.col("doc_id").alias("gone_id"), "digest")
    left = documents.join(others, documents[key].cast("long").eqNullSafe(others["gone_id"]) & (digest == others["digest"]), "left_anti")
    if gone.where("again").isEmpty():
        return left
    d = spare_name(left)
    return left.withColumn(d, digest).dropDuplicates([key, d]).drop(d)


ORACLE_SQL = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, text_sha256
from d window w as (partition by text_sha256)
"""
