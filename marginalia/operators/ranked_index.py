"""A stored search index that finds the best rows without ranking all matches.

``save`` deals the documents into blocks by their length, for short documents rank higher
for a word than long ones, and keeps for each term and block the largest rank that the term
gives a document of it.  The sum of a query's terms bounds the rank of each document of a
block.  ``top`` first ranks the FIRST blocks of the highest bounds; the rank of the last row
wanted, found there, is the threshold, and of all other blocks only those are read whose
bound reaches it.  So the rows are those of the full ranking.

Postings lie in folders by a hash of the term; their number follows the index' size, and a
folder is written by ranges of (term, block), so a common term is spread over several tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import search as S

#: Documents of a block, blocks that give the threshold, rows of a folder.
BLOCK_DOCS, FIRST, FOLDER_ROWS, FEWEST_FOLDERS, MOST_FOLDERS = 256, 8, 4_000_000, 16, 2048
#: Digits of a rank that count for the order.
DIGITS = 6


def _folder(n: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(n)).cast("int").alias("bucket")


def score() -> Column:
    """What a posting adds to its document's rank."""
    return F.col("weight") * (1 + F.log("tf")) / (1 + F.log("doc_len"))


class RankedIndex:
    """An index stored under ``path``: ``postings`` and ``bounds``, both by folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.folders, self.language = spark.read.parquet(f"{path}/shape").first()

    def _of(self, name: str, terms: list[str]) -> DataFrame:
        """The rows of some terms; only their folders are read."""
        return S.of_terms(self.spark.read.parquet(f"{self.path}/{name}"), terms, self.folders)

    def postings(self, query: S.Query) -> DataFrame:
        return self._of("postings", query.all_terms)

    def blocks(self, query: S.Query) -> DataFrame:
        """``block, bound``: the blocks in which each group of required phrases has a phrase with all its terms."""
        met = self._of("bounds", query.terms).groupBy("block").agg(F.collect_list(F.struct("term", "most")).alias("t"))
        has = lambda term: F.exists("t", lambda x: x["term"] == term)
        for group in query.required:
            anyone = F.lit(False)
            for phrase in group:
                every = F.lit(True)
                for _, term in phrase:
                    every = every & has(term)
                anyone = anyone | every
            met = met.where(anyone)
        return met.select("block", F.aggregate("t", F.lit(0.0), lambda s, x: s + x["most"]).alias("bound"))


def save(docs: DataFrame, path: str, id_col: str, fields: dict[str, str], language: str | None = None) -> RankedIndex:
    """Index ``fields`` (columns to weight classes) of ``docs`` under ``path``."""
    spark = docs.sparkSession
    S.every_posting(docs, id_col, fields, language).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    size = lambda longest: F.floor(2 * F.log2(longest)).cast("long")
    lengths = rows.groupBy("doc_id").agg(size(F.max("longest")).alias("size"))
    parts = lengths.groupBy("size").agg(F.ceil(F.count("*") / BLOCK_DOCS).alias("parts"))  # a row for each order of length
    block = F.col("size") * (1 << 40) + F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    folders = max(FEWEST_FOLDERS, min(MOST_FOLDERS, rows.count() // FOLDER_ROWS))
    # each row knows its document's length, so its block needs no shuffle; the count of positions is left out of the one that sorts
    rows = rows.withColumn("size", size(F.col("longest"))).join(F.broadcast(parts), "size").select("doc_id", "term", "weight", "positions", "doc_len", block.alias("block"), _folder(folders))
    dealt = rows.repartitionByRange("bucket", "term", "block", "doc_id").sortWithinPartitions("bucket", "term", "block", "doc_id")
    dealt.withColumn("tf", F.size("positions").cast("long")).write.partitionBy("bucket").parquet(f"{path}/postings")
    # the largest of each field, added up, is no less than any document's sum; rows lie in order, so they meet before the shuffle
    held = spark.read.parquet(f"{path}/postings").groupBy("bucket", "term", "block").agg(*(F.max(F.when(F.col("weight") == w, score())).alias(f"s{k}") for k, w in enumerate(sorted(set(S.WEIGHTS.values())))))
    bounds = held.select("bucket", "term", "block", reduce(Column.__add__, [F.coalesce(f"s{k}", F.lit(0.0)) for k in range(len(set(S.WEIGHTS.values())))]).alias("most"))
    bounds.repartitionByRange("bucket", "term", "block").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/bounds")
    spark.createDataFrame([(int(folders), language)], "folders int, language string").write.parquet(f"{path}/shape")
    return RankedIndex(spark, path)


def matches(index: RankedIndex, text: str, blocks: list[int] | DataFrame | None = None) -> DataFrame:
    """``doc_id, rank`` of the documents that the query selects, of some blocks or of all."""
    query = S.parse_query(text, index.language)
    rows = index.postings(query).drop("bucket")
    if isinstance(blocks, list):
        rows = rows.where(F.col("block").isin(blocks))
    elif blocks is not None:
        rows = rows.join(blocks, "block", "left_semi")
    return S.evaluate(rows, query).where("by_words").select("doc_id", F.round("rank", DIGITS).alias("rank"))


def blocks_read(index: RankedIndex, text: str, k: int) -> tuple[list[int], DataFrame, float | None]:
    """The blocks that are read first, the further ones that may hold a row of the best ``k``, and the threshold (none: fewer rows were found)."""
    query = S.parse_query(text, index.language)
    bounds = index.blocks(query)
    first = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(FIRST).collect()]  # FIRST rows
    ranks = [r["rank"] for r in matches(index, text, first).orderBy(F.desc("rank")).limit(k).collect()] if first else []
    threshold = ranks[-1] if len(ranks) == k else None
    others = bounds.where(~F.col("block").isin(first))
    # a rank is rounded, its bound isn't
    return first, others.where(F.col("bound") >= threshold - 10**-DIGITS) if threshold is not None else others, threshold


def top(index: RankedIndex, text: str, k: int = 20) -> DataFrame:
    """``doc_id, rank``: the best ``k`` documents of a query with at least one required word, larger ids first among equals."""
    query = S.parse_query(text, index.language)
    if not query.required:
        raise ValueError("a query that only excludes has no ranks")
    first, others, _ = blocks_read(index, text, k)
    found = matches(index, text, first).union(matches(index, text, others.select("block")))
    return found.orderBy(F.desc("rank"), F.desc("doc_id")).limit(k)
