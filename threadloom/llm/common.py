"""What the corpus operators share: stage tables in the shared folder, text columns, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where it is unset, as in tests."""
    set_to = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        set_to = f"file://{tempfile.mkdtemp(prefix='threadloom-')}"
        spark.conf.set("spark.checkpoint.dir", set_to)
    return set_to


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    The written table cuts the lineage: a lost executor costs a re-read, never a recomputation of what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stages/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the byte-wise built-in; others are translated."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def spare_name(df: DataFrame, name: str = "spare") -> str:
    """A column name that df does not have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def draw_limit(wanted: int, rows: int) -> int:
    """About `wanted` of so many rows have a 63-bit hash up to this."""
    return max(1, (2**63 - 1) * min(wanted, rows) // max(rows, 1))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a column `name` that tells its rows apart, repeated rows too. Stable once the result is staged."""
    return df.withColumn(name, F.monotonically_increasing_id())


#: A bit filter is an array of longs in blocks of so many bits; 2**27 bits are 16 MiB of blocks, which may be broadcast.
BLOCK_BITS, MOST_FILTER_BITS = 32768, 1 << 27


def filter_bits(rows: int, most: int = MOST_FILTER_BITS) -> int:
    bits = BLOCK_BITS
    while bits < min(most, 32 * rows):
        bits *= 2
    return min(bits, most)


def cell_of(h: Column, bits: int) -> tuple[Column, Column]:
    """(block, bit within it) of a hash in a filter of so many bits."""
    return F.pmod(F.shiftrightunsigned(h, 15), F.lit(bits // BLOCK_BITS)).cast("int"), F.pmod(h, F.lit(BLOCK_BITS)).cast("int")


def bit_blocks(cells: DataFrame) -> DataFrame:
    """(block, longs) of the cells (block, bit) that are set. Longs are combined before any shuffle."""
    longs = cells.groupBy("block", F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(63))).alias("bits"))
    by_block = longs.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("at", "bits"))).alias("set"))
    return by_block.select("block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), lambda i: F.coalesce(F.element_at("set", i), F.lit(0).cast("long"))).alias("longs"))


def bit_set(longs: Column, bit: Column) -> Column:
    return F.getbit(F.get(longs, F.shiftright(bit, 6)), bit.bitwiseAND(63)) == 1


def maybe_in(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """The rows whose keys are in wanted, and a few others, found before any shuffle by a broadcast bit filter.

    The filter has MOST_FILTER_BITS bits at most. With far more wanted keys than that it is full and lets all rows pass.
    """
    bits = filter_bits(wanted.count())
    block, bit = cell_of(F.xxhash64(*keys), bits)
    blocks = staged(bit_blocks(wanted.select(block.alias("block"), bit.alias("bit"))), "bit-filter").select(F.col("block").alias("filter_block"), F.col("longs").alias("filter_longs"))
    return rows.join(F.broadcast(blocks), block == F.col("filter_block")).where(bit_set(F.col("filter_longs"), bit)).drop("filter_block", "filter_longs")


def components(spark: SparkSession, edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node that can be reached.

    Min-label propagation with pointer jumping; each round is two aggregations with map-side combine and one join,
    staged, and the rounds grow with the logarithm of the longest path.
    """
    both = staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    label = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), f"{name}-label")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hop = label.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = label.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
        label = staged(hop.join(jump, "component").select("node", "was", F.least("component", "beyond").alias("component")), f"{name}-label")
        if label.where("component <> was").isEmpty():
            return label.select("node", "component")
        label = label.select("node", "component")
