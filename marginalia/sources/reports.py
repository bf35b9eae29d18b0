"""Plans and reports as data: written as JSON, read back with their schema, then applied by a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def alive(spark: SparkSession) -> DataFrame:
    """A liveness probe."""
    return spark.sql("SELECT 1 AS ok")


def seed(old: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Bootstrap rows whose keys aren't there yet, added to the old ones; running it again changes nothing."""
    return old.unionByName(rows.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def backfill(rows: DataFrame, column: str, value) -> DataFrame:
    """A default put where the column is null."""
    return rows.withColumn(column, F.coalesce(F.col(column), F.lit(value)))
