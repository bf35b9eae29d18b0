"""The driver's tables in the roles of the engine's own: cards, tags, links, spans, lists, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.spans import span


#: Bytes between which a table in fewer files than cores is dealt out anew.
SPREAD_LEAST, SPREAD_MOST = 1 << 20, 256 << 20
TEXTS = ("documents", "pages", "conversations")


def spread(table: DataFrame) -> DataFrame:
    """The same rows, dealt over all cores if they come from fewer files than there are cores.

    A file of one row group is one task, however many cores wait.  Only tables of a checked
    size are dealt out, for which that costs next to nothing; large ones have files enough.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    if len(table.inputFiles()) >= cores:
        return table
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(cores) if SPREAD_LEAST <= size <= SPREAD_MOST else table


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table; those of texts, whose work lies in the map stage, are dealt over all cores if they are small."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table) if name in TEXTS else table


def cards(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their vectors: about half of them have one."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").cast("array<double>").alias("embedding"))
    docs = read(spark, d, "documents")
    return docs.join(e, docs["doc_id"] == e["v"], "left").drop("v")


def tags(spark: SparkSession, d: str) -> DataFrame:
    """Regions as roots, nations below them from id 100 on."""
    r = read(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("tag_id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_name").alias("label"))
    n = read(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("tag_id"), F.col("n_regionkey").cast("long").alias("parent_id"), F.col("n_name").alias("label"))
    return r.union(n)


def card_links(spark: SparkSession, d: str) -> DataFrame:
    """Customers as cards, tagged with their nation, every third also with a region."""
    c = read(spark, d, "customer")
    own = c.select(F.col("c_custkey").alias("card_id"), (F.col("c_nationkey") + 100).cast("long").alias("tag_id"), F.when(F.col("c_custkey") % 2 == 0, "approved").otherwise("proposed").alias("status"))
    top = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("card_id"), (F.col("c_custkey") % 5).alias("tag_id"), F.lit("proposed").alias("status"))
    return own.union(top)


def argument_links(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as sourceless arguments."""
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("card_id"), (F.col("s_nationkey") + 100).cast("long").alias("tag_id"))


def span_lists(spark: SparkSession, d: str) -> DataFrame:
    """``id, spans``: line items as mark-up of their order, in line order."""
    li = read(spark, d, "lineitem")
    start = (F.col("l_partkey") % 100).cast("int")
    kind = F.when(F.col("l_returnflag") == "N", "underline").otherwise("highlight")
    made = li.select(F.col("l_orderkey").alias("id"), "l_linenumber", span(start, start + F.col("l_quantity").cast("int"), kind).alias("s"))
    listed = made.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "s"))).alias("x"))
    return listed.select("id", F.transform("x", lambda x: x["s"]).alias("spans"))


def sources(spark: SparkSession, d: str) -> DataFrame:
    """Parts as works: the brand's letters as author, size as year, type as title."""
    p = read(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("source_id"), F.col("p_brand").alias("author"), (1980 + F.col("p_size") % 8).alias("year"), F.col("p_name").alias("author_full"),
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(" HTTPS://x.example/"), F.lower("p_type"), F.lit("/#top"))).alias("url"), F.col("p_type").alias("title"),
    )


def source_cards(spark: SparkSession, d: str) -> DataFrame:
    """Line items as cards of their part."""
    return read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("card_id"), F.col("l_partkey").alias("source_id"))
