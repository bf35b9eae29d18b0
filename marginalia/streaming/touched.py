"""Seen-dates of files as a bucketed table, of which a merge rewrites only the buckets it touches.

Rows lie in folders by a hash of their key.  A merge reads the buckets that the batch has
keys of, merges them, and overwrites just these folders (dynamic partition overwrite); all
other files stay as they are.  The merged rows are first written beside the table: a batch
that fails while they are made leaves the table as it was.  The overwrite itself moves
finished files; if it is cut off, or the stream repeats the batch, merging again gives the
same table, for the first date only moves back and the last only forward.

One writer at a time: two that touch the same bucket would each keep their own version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class BucketedSeen:
    """``key, first_seen, last_seen`` under ``path``; ``scratch`` is a folder beside it that all executors see."""

    def __init__(self, spark: SparkSession, path: str, scratch: str, key: str = "file_sha256", kind: str = "string", buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.scratch, self.key, self.buckets = spark, path, scratch, key, buckets
        self.schema = f"{key} {kind}, first_seen date, last_seen date, bucket int"
        self.folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _exists(self) -> bool:
        return self.folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(self.folder)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        """The table with its ``bucket``."""
        return self.spark.read.schema(self.schema).parquet(self.path) if self._exists() else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, batch_id: int | None = None) -> list[int]:
        """For ``foreachBatch``: batch has the key and ``seen``.  Returns the buckets that were rewritten."""
        parts = f"{self.scratch}/merge-{uuid.uuid4().hex}"
        seen = batch.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))
        seen.withColumn("bucket", self._bucket()).write.parquet(f"{parts}/batch")
        seen = self.spark.read.parquet(f"{parts}/batch")
        touched = sorted(r[0] for r in seen.select("bucket").distinct().collect())  # a number for each bucket
        if not touched:
            return []
        old = self.read().where(F.col("bucket").isin(touched)).drop("bucket")
        both = old.unionByName(seen.drop("bucket"))
        merged = both.groupBy(self.key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")).withColumn("bucket", self._bucket())
        merged.write.parquet(f"{parts}/merged")
        done = self.spark.read.parquet(f"{parts}/merged")
        done.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        return touched
