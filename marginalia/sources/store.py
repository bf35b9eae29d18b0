"""Tables that change by commits: a version is written whole, then one rename makes it the current one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """Versions of a table under one folder.

    Readers see the version that the pointer file names.  A commit writes a fresh folder
    and then renames a new pointer over the old one, in one step of the file system; so a
    commit that fails anywhere changes nothing, and no reader sees half of one.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.jvm = spark.sparkContext._jvm
        self.pointer = self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/_current")

    def _files(self):
        return self.pointer.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> str | None:
        """The current version's name; none before the first commit."""
        if not self._files().exists(self.pointer):
            return None
        stream = self._files().open(self.pointer)
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def read(self) -> DataFrame:
        at = self.version()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{at}") if at else self.spark.createDataFrame([], self.schema)

    def commit(self, df: DataFrame) -> str:
        """Make ``df``, which may read the current version, the new one."""
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{version}")
        fresh = self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/_next-{version}")
        stream = self._files().create(fresh)
        try:
            stream.writeUTF(version)
        finally:
            stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.pointer.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(fresh, self.pointer, how)
        return version
