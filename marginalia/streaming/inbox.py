"""An inbox of Word files: each file's items are stored once, and files that gave items move away.

A file stream takes the new files below ``root`` in batches.  A batch's items are written to
a folder of its own, and only when that is complete are its files moved below ``done`` with
their sub-paths.  A file that gives no items, because it is no document or has none, stays
where it is and is reported in the batch's ``left``.  A run that is cut off repeats its
last batch: a batch that is complete isn't read again, only the rest of its files is moved;
one that isn't is written anew, and none of its files has moved.  So each file's items are
there exactly once, whenever the run stops.

The driver moves the files of one batch, ``most`` of them at a time.  A path is taken once:
a new version of a file needs a new name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.operators.ingest import Extracted, extract

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


class Inbox:
    """``root``: where files arrive; ``done``: where they go; ``table``: the folder of items, errors and the stream's marks."""

    def __init__(self, spark: SparkSession, root: str, done: str, table: str, take: Callable[[DataFrame], Extracted] = extract, most: int = 100, skip_dirs: tuple[str, ...] = ("garbage",)) -> None:
        self.spark, self.root, self.done, self.table = spark, root.rstrip("/"), done.rstrip("/"), table.rstrip("/")
        self.take, self.most, self.skip_dirs = take, most, skip_dirs

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, path: str):
        return self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _complete(self, folder: str) -> bool:
        return self._files(folder).exists(self._path(f"{folder}/_SUCCESS"))

    def start(self) -> StreamingQuery:
        """Take all files that are there, then stop."""
        files = self.spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[dD][oO][cC][xX]").option("maxFilesPerTrigger", self.most).load(self.root)
        kept = files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, self.skip_dirs))))
        return kept.writeStream.foreachBatch(self.store).option("checkpointLocation", f"{self.table}/_stream").trigger(availableNow=True).start()

    def store(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: the items of a batch's files, then their move."""
        items, left = f"{self.table}/items/batch={batch_id}", f"{self.table}/left/batch={batch_id}"
        if not self._complete(left):  # the second of the two, so both are
            found = self.take(batch.select("path", "content"))
            found.items.write.mode("overwrite").parquet(items)
            gave = self.spark.read.parquet(items).select(F.col("file").alias("_file")).distinct()
            stay = batch.select("path").join(gave, F.col("path") == F.col("_file"), "left_anti")
            errors = found.errors.withColumnRenamed("path", "_path")
            stay.join(errors, F.col("path") == F.col("_path"), "left").select("path", F.coalesce("error", F.lit("no items")).alias("error")).write.mode("overwrite").parquet(left)
        for row in self.spark.read.parquet(items).select("file").distinct().collect():  # the files of one batch
            self.move(row["file"])

    def target(self, path: str) -> str:
        """Where a file goes: below ``done`` as it lay below ``root``."""
        plain = lambda p: self._path(p).toUri().getPath()
        return f"{self.done}/{plain(path)[len(plain(self.root)) :].lstrip('/')}"

    def move(self, path: str) -> None:
        """Move a file if it is still there."""
        old, new = self._path(path), self._path(self.target(path))
        files = self._files(path)
        if files.exists(old):
            files.mkdirs(new.getParent())
            if not files.rename(old, new):
                raise OSError(f"can't move {path} to {new}")

    def items(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.table}/items")

    def left(self) -> DataFrame:
        """``path, error`` of the files that stayed."""
        return self.spark.read.parquet(f"{self.table}/left").select("path", "error")
