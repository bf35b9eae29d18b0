"""Substring search by a stored index of trigrams, whatever the case.

``build`` stores each distinct run of three characters of each column's lower-case text as
rows (gram, field, id), in folders by a hash of the gram and sorted, and how many rows each
gram has.  A pattern's literal pieces (between ``%`` and ``_``) have grams that every match
must hold.  ``matching`` reads the folders of the rarest of them, keeps the rows that have
them all in one field, and checks the pattern itself on those.  A pattern without a piece of
three characters has no grams, and all rows are checked.

Ranges of (gram, id) are dealt to the writing tasks, so a gram that stands in a third of all
rows is spread over several.  Null texts have no grams and match nothing; rows without an id
aren't found through the index.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 3
#: Grams of a pattern that are looked up, the rarest first, and rows of a folder.
LOOKED_UP, FOLDER_ROWS, FEWEST_FOLDERS, MOST_FOLDERS = 4, 2_000_000, 16, 1024


def grams(text: Column) -> Column:
    """The distinct runs of three characters of the lower-case text."""
    chars = F.split(F.lower(text), "")
    runs = F.transform(F.sequence(F.lit(0), F.size(chars) - SIZE), lambda i: F.concat(*(F.get(chars, i + k) for k in range(SIZE))))
    return F.when(F.char_length(text) >= SIZE, F.array_distinct(runs))


def pieces(pattern: str) -> list[str]:
    """The literal pieces of a LIKE pattern; a backslash makes the next character literal."""
    out, at = [""], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            at += 1
            out[-1] += pattern[at]
        elif c in "%_":
            out.append("")
        else:
            out[-1] += c
        at += 1
    return [p for p in out if p]


class GramIndex:
    """An index of some columns stored under ``path``: ``postings`` and ``counts``, both by folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.folders, self.columns = spark.read.parquet(f"{path}/shape").first()

    def _read(self, name: str, wanted: list[str]) -> DataFrame:
        """The rows of some grams; only their folders are read."""
        folders = self.spark.createDataFrame([(g,) for g in wanted], "gram string").select(_folder(self.folders)).distinct().collect()  # one for each gram
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("folder").isin([r[0] for r in folders]) & F.col("gram").isin(wanted))

    def grams_of(self, pattern: str) -> list[str]:
        """The rarest grams that a match of ``%pattern%`` must hold; none if its pieces are too short."""
        low = self.spark.range(1).select(F.lower(F.lit(pattern))).first()[0]
        found = sorted({p[i : i + SIZE] for p in pieces(low) for i in range(len(p) - SIZE + 1)})
        if not found:
            return []
        n = {r["gram"]: r["n"] for r in self._read("counts", found).collect()}  # a row for each gram of the pattern
        return sorted(found, key=lambda g: (n.get(g, 0), g))[:LOOKED_UP]

    def candidates(self, wanted: list[str]) -> DataFrame:
        """``id`` of the rows with all these grams in one column."""
        met = self._read("postings", wanted).groupBy("id", "field").agg(F.count("*").alias("n"))
        return met.where(F.col("n") == len(wanted)).select("id").distinct()


def _folder(n: int) -> Column:
    return F.pmod(F.xxhash64("gram"), F.lit(n)).cast("int").alias("folder")


def build(rows: DataFrame, path: str, id_col: str, columns: list[str]) -> GramIndex:
    """Index ``columns`` of ``rows`` under ``path``."""
    spark = rows.sparkSession
    named = rows.where(F.col(id_col).isNotNull())
    parts = [named.select(F.explode(grams(F.col(c))).alias("gram"), F.lit(k).alias("field"), F.col(id_col).alias("id")) for k, c in enumerate(columns)]
    every = reduce(DataFrame.union, parts).distinct()
    every.write.parquet(f"{path}/rows")
    every = spark.read.parquet(f"{path}/rows")
    folders = max(FEWEST_FOLDERS, min(MOST_FOLDERS, every.count() // FOLDER_ROWS))
    placed = every.withColumn("folder", _folder(folders))
    placed.repartitionByRange("folder", "gram", "id").sortWithinPartitions("folder", "gram", "id").write.partitionBy("folder").parquet(f"{path}/postings")
    counts = every.groupBy("gram").agg(F.count("*").alias("n")).withColumn("folder", _folder(folders))
    counts.repartition("folder").sortWithinPartitions("folder", "gram").write.partitionBy("folder").parquet(f"{path}/counts")
    spark.createDataFrame([(int(folders), list(columns))], "folders int, columns array<string>").write.parquet(f"{path}/shape")
    return GramIndex(spark, path)


def matching(rows: DataFrame, index: GramIndex, pattern: str, id_col: str) -> DataFrame:
    """Rows of which some indexed column holds the pattern, whatever the case; ``%`` and ``_`` are wildcards."""
    wanted = index.grams_of(pattern)
    some = rows.join(index.candidates(wanted).withColumnRenamed("id", "_found"), F.col(id_col) == F.col("_found"), "left_semi") if wanted else rows
    return some.where(reduce(Column.__or__, [F.coalesce(F.ilike(F.col(c), F.lit(f"%{pattern}%")), F.lit(False)) for c in index.columns]))
