"""Source entity resolution: which sources are the same work, and merging them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import author_without_year, cleaned_cite, identifier, url_normal

#: Shorter author names say too little.
LEAST_AUTHOR = 3


def merge_plan(sources: DataFrame, cards: DataFrame) -> DataFrame:
    """A row for each member of a merge group: ``norm_author, year, match_key, source_id, canonical_id, n_cards, rk, members``.

    Same author and year, and the same address; without an address the same title.  A
    source with an address thus never merges with one that has a title only.  The
    canonical one has most cards, then the longest full author, then the smallest id.
    """
    used = cards.groupBy(F.col("source_id").alias("_s")).agg(F.count("*").alias("n_cards"))
    known = sources.where("author is not null and year is not null").join(used, F.col("source_id") == F.col("_s"), "left").withColumn("n_cards", F.coalesce("n_cards", F.lit(0)))
    url, title = url_normal(F.col("url")), identifier(F.col("title"))
    key = F.when(url != "", F.concat(F.lit("url:"), url)).when(title != "", F.concat(F.lit("title:"), title))
    keyed = known.withColumn("norm_author", identifier(F.col("author"))).withColumn("match_key", key).where((F.length("norm_author") >= LEAST_AUTHOR) & F.col("match_key").isNotNull())
    group = Window.partitionBy("norm_author", "year", "match_key")
    order = group.orderBy(F.col("n_cards").desc(), F.length(F.coalesce("author_full", F.lit(""))).desc(), "source_id")
    ranked = keyed.withColumn("rk", F.row_number().over(order)).withColumn("canonical_id", F.first("source_id").over(order)).withColumn("members", F.count("*").over(group))
    return ranked.where("members >= 2").select("norm_author", "year", "match_key", "source_id", "canonical_id", "n_cards", "rk", "members")


def cleaned(sources: DataFrame, overrides: DataFrame) -> DataFrame:
    """``source_id, cite_short, author, reason`` of the sources whose short cite or author changes.

    An override (source_id, new_cite, new_author) wins over the rules.
    """
    given = overrides.select(F.col("source_id").alias("_o"), "new_cite", "new_author")
    out = sources.join(given, F.col("source_id") == F.col("_o"), "left")
    manual = F.col("_o").isNotNull()
    cite = F.when(manual, F.col("new_cite")).otherwise(cleaned_cite(F.col("cite_short")))
    author = F.when(manual, F.col("new_author")).otherwise(author_without_year(cleaned_cite(F.coalesce("author", F.lit("")))))
    changed = ~cite.eqNullSafe(F.col("cite_short")) | ~author.eqNullSafe(F.col("author"))
    return out.where(changed).select("source_id", cite.alias("cite_short"), author.alias("author"), F.when(manual, "manual").otherwise("auto").alias("reason"))


def merge_groups(plan: DataFrame) -> DataFrame:
    """A row for each group with the cards it would move, the largest first."""
    out = plan.groupBy("norm_author", "year", "match_key", "canonical_id").agg(F.count_if(F.col("rk") > 1).alias("losers"), F.sum(F.when(F.col("rk") > 1, F.col("n_cards")).otherwise(0)).alias("cards_repointed"))
    return out.orderBy(F.col("cards_repointed").desc(), "canonical_id")


def merge_summary(plan: DataFrame) -> DataFrame:
    lost = F.col("rk") > 1
    return plan.agg(F.count_if(~lost).alias("groups"), F.count_if(lost).alias("sources_merged"), F.coalesce(F.sum(F.when(lost, F.col("n_cards"))), F.lit(0)).alias("cards_repointed"))


def repoint(cards: DataFrame, plan: DataFrame) -> DataFrame:
    """``cards`` with the sources of losers replaced by their canonical ones."""
    to = plan.where("rk > 1").select(F.col("source_id").alias("_from"), F.col("canonical_id").alias("_to"))
    out = cards.join(to, F.col("source_id") == F.col("_from"), "left")
    return out.withColumn("source_id", F.coalesce("_to", "source_id")).drop("_from", "_to")


def surviving(sources: DataFrame, plan: DataFrame) -> DataFrame:
    gone = plan.where("rk > 1").select(F.col("source_id").alias("_gone"))
    return sources.join(gone, F.col("source_id") == F.col("_gone"), "left_anti")


def detail(sources: DataFrame, cards: DataFrame, source_id: int) -> DataFrame:
    """A source with its cards, hidden duplicates too, in the order of their ids."""
    return in_id_order(sources.where(F.col("source_id") == source_id).join(cards.withColumnRenamed("source_id", "_s"), F.col("source_id") == F.col("_s")).drop("_s"), "card_id")


def in_id_order(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.orderBy(id_col)
