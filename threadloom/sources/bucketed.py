"""Relations in folders by a hash of their thread, of which a batch rewrites only those that it touches."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from threadloom.sources.store import nothing

_BUCKET = (StructField("bucket", IntegerType()),)


@dataclass(frozen=True)
class Bucketed:
    """A relation in `buckets` folders. key: the columns of a thread, which no row has null.

    A rewrite goes to a folder of its own first and then replaces whole buckets by dynamic partition overwrite. A batch that dies in
    between is run again: it finds some buckets already replaced, and its result is the same. Each bucket has a row with a null key, which
    readers never see, so that one that loses its last row is overwritten too.
    """

    spark: SparkSession
    path: str
    schema: StructType
    key: tuple[str, ...] = ("repo", "number")
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in self.key)), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        try:
            return self.spark.read.schema(StructType([*self.schema, *_BUCKET])).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return nothing(self.spark, StructType([*self.schema, *_BUCKET]))
            raise

    def read(self) -> DataFrame:
        return self._stored().where(F.col(self.key[0]).isNotNull()).drop("bucket")

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of some threads: at most `buckets` numbers."""
        return [r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect()]

    def of(self, keys: DataFrame, touched: Sequence[int] | None = None) -> DataFrame:
        """The rows of some threads; only their folders are read."""
        mine = self._stored().where(F.col("bucket").isin(list(self.touched(keys) if touched is None else touched)) & F.col(self.key[0]).isNotNull())
        return mine.drop("bucket").join(keys.select(*self.key).distinct(), list(self.key), "left_semi")

    def prepare(self, rows: DataFrame, keys: DataFrame, touched: Sequence[int] | None = None) -> str | None:
        """Write aside what the buckets of `keys` will hold when `rows` are all that these threads have; None where there are none."""
        touched = list(self.touched(keys) if touched is None else touched)
        if not touched:
            return None
        rest = self._stored().where(F.col("bucket").isin(touched) & F.col(self.key[0]).isNotNull()).drop("bucket").join(keys.select(*self.key).distinct(), list(self.key), "left_anti")
        new = rest.select(self.schema.names).unionByName(rows.select(self.schema.names)).withColumn("bucket", self.bucket())
        none = self.spark.range(0, self.buckets, 1, 1).select(F.col("id").cast("int").alias("bucket")).where(F.col("bucket").isin(touched)).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema), "bucket")
        aside = f"{self.path.rstrip('/')}.aside/{uuid.uuid4().hex}"
        new.unionByName(none).hint("rebalance", "bucket").sortWithinPartitions("bucket", *self.key).write.parquet(aside)
        return aside

    def install(self, aside: str | None) -> None:
        """Put the buckets that prepare wrote in place. Doing it again changes nothing."""
        if aside is not None:
            rows = self.spark.read.schema(StructType([*self.schema, *_BUCKET])).parquet(aside)
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def replace(self, rows: DataFrame, keys: DataFrame) -> None:
        """Make `rows` all that the threads of `keys` have. Buckets of other threads are not written."""
        self.install(self.prepare(rows, keys))

    def append(self, rows: DataFrame) -> None:
        """Add rows; nothing that is there is read or written again."""
        rows.select(self.schema.names).withColumn("bucket", self.bucket()).write.mode("append").partitionBy("bucket").parquet(self.path)

