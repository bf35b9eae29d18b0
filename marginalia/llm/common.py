"""Helpers shared by the training-data operators: inputs, staging and Arrow maps.

Nothing in the rest of the library imports this subpackage.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.batches import BATCH_BYTES, BATCH_ROWS, small_batches  # noqa: F401
from marginalia.plans.tables import spread

_SCRATCH: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table, read only through Spark's own readers, small ones dealt over all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may go without that setting; it then gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = "local"
    if key not in _SCRATCH:
        _SCRATCH[key] = [tempfile.mkdtemp(prefix="marginalia-")]
    return "file://" + _SCRATCH[key][0]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Stage:
    """A scratch folder of one operator run.

    ``put`` writes a DataFrame as Parquet and reads it back, which cuts the lineage:
    later steps survive lost executors without repeating the earlier ones.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{scratch_root(spark)}/marginalia/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.path}/{name}")

    def close(self) -> None:
        try:
            _delete(self.spark, self.path)
        except Exception:  # the session may be gone at exit; the folder is scratch
            pass


def bucket_of(column: str, n: int):
    """``crc32(column as text) mod n``, the fold rule of the contracts; -1 for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(-1)).cast("int")
