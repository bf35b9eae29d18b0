"""Choosing one canonical card of near-duplicates, with a reason for each decision."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import spans as S
from marginalia.functions import text as T
from marginalia.plans.components import connected_components, splittable_join

# Limits of the decision rules.
MARGIN, SCORE_FLOOR, GOOD_ENOUGH = 1.10, 0.50, 0.55
CLUSTER_PAGE = 25
MARKUP_FLOOR, TIGHT_MARKUP_FLOOR, TAG_SAME, TAG_FLOOR = 0.80, 0.50, 0.85, 0.30
#: Cards of a cluster up to which it is one row.
PAIRWISE = 64


def eligible(cards: DataFrame, need_vector: bool = True) -> DataFrame:
    """Visible cards that may be merged; with a vector if neighbours are looked for."""
    out = cards.where("canonical_card_id is null and not coalesce(dedup_excluded, false)")
    return out.where("embedding is not null") if need_vector else out


def card_score(tag: Column, source_file: Column, cite: Column, year: Column, wiki_upload_id: Column) -> Column:
    """0.55 tag + 0.35 cite + 0.05 for the own corpus + 0.05, half-even to four places."""
    own = F.when(wiki_upload_id.isNull(), 0.05).otherwise(0.0)
    return F.bround(T.tag_quality(tag, source_file) * 0.55 + T.cite_quality(cite, year) * 0.35 + own + 0.05, 4)


def clusters(pairs: DataFrame, put: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``card_id, cluster, size`` of the components of a pair list (a, b), of two cards at least."""
    found = connected_components(pairs, put).select(F.col("node").alias("card_id"), F.col("component").alias("cluster"))
    return splittable_join(found, found.groupBy("cluster").agg(F.count("*").alias("size")), "cluster").select("card_id", "cluster", "size")


def cluster_page(clustered: DataFrame, number: int = 1, size: int = CLUSTER_PAGE) -> DataFrame:
    """``page, pages, place, cluster, size``: one page of clusters, the largest first, then the smallest id; pages beyond the last show it."""
    sizes = clustered.groupBy("cluster").agg(F.count("*").alias("size"))
    pages = max(1, math.ceil(sizes.count() / size))
    page = min(max(1, number), pages)
    shown = sizes.orderBy(F.col("size").desc(), "cluster").offset((page - 1) * size).limit(size)
    place = F.row_number().over(Window.orderBy(F.col("size").desc(), "cluster")) + (page - 1) * size  # of one page's rows
    return shown.select(F.lit(page).alias("page"), F.lit(pages).alias("pages"), place.alias("place"), "cluster", "size")


def source_clusters(cards: DataFrame, least: int = 2) -> DataFrame:
    """Cards of one source, of which there are ``least`` or more: ``card_id, cluster, size``."""
    n = cards.groupBy("source_id").agg(F.count("*").alias("size"), F.min("card_id").alias("cluster")).where(F.col("size") >= least)
    return cards.join(n, "source_id").select("card_id", "cluster", "size")


def subclusters(members: DataFrame, put: Callable[[DataFrame, str], DataFrame], floor: float = TAG_FLOOR) -> DataFrame:
    """``cluster, card_id, sub``: parts of a cluster connected by like tags; ``sub`` is the part's smallest card.

    A cluster of up to ``PAIRWISE`` cards is one row, whose cards are compared where it lies, so a tag is taken
    apart and sent once; only larger clusters send a row for each word.
    """
    worded = members.select("cluster", "card_id", T.content_words(F.col("tag")).alias("words"))
    large = put(members.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") > PAIRWISE).select("cluster"), "large")
    if large.isEmpty():
        alike = _alike_within(worded, floor)
    else:
        alike = _alike_within(worded.join(large, "cluster", "left_anti"), floor).union(_alike_by_words(worded.join(large, "cluster", "left_semi"), floor))
    parts = connected_components(alike, put)
    return members.select("cluster", "card_id").join(parts, F.col("card_id") == F.col("node"), "left").select("cluster", "card_id", F.coalesce("component", "card_id").alias("sub"))


def _alike_within(worded: DataFrame, floor: float) -> DataFrame:
    """``a, b``: like cards of a cluster, from all pairs of its cards; sets whose sizes alone keep them apart aren't compared."""
    cards = worded.where("cluster is not null").select("cluster", F.struct("card_id", F.size("words").alias("n"), "words").alias("card"))
    together = cards.groupBy("cluster").agg(F.collect_list("card").alias("cards"))

    def may_be(x: Column, y: Column) -> Column:
        more = F.greatest(x["n"], y["n"])
        return (x["card_id"] < y["card_id"]) & F.when(more == 0, True).otherwise(F.least(x["n"], y["n"]) / more >= floor)

    def like(p: Column) -> Column:
        return F.when(p["n"] == 0, True).otherwise(p["shared"] / (p["n"] - p["shared"]) >= floor)

    def with_later(x: Column) -> Column:
        met = F.transform(F.filter("cards", lambda y: may_be(x, y)), lambda y: F.struct(x["card_id"].alias("a"), y["card_id"].alias("b"), (x["n"] + y["n"]).alias("n"), F.size(F.array_intersect(x["words"], y["words"])).alias("shared")))
        return F.transform(F.filter(met, like), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b")))

    return together.select(F.inline(F.flatten(F.transform("cards", with_later))))


def _alike_by_words(worded: DataFrame, floor: float) -> DataFrame:
    """``a, b``: like cards of a cluster.  Cards that share a content word meet on it; only cards without any
    content word meet each other directly, through the smallest of them, for they are all alike.
    """
    sized = worded.withColumn("n", F.size("words"))
    words = sized.select("cluster", "card_id", "n", F.explode("words").alias("word"))
    left, right = (words.select("cluster", "word", F.col("card_id").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    met = left.join(right, ["cluster", "word"]).where("a < b").groupBy("cluster", "a", "b", "n_a", "n_b").agg(F.count("*").alias("shared"))
    alike = met.where(F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")) >= floor).select("a", "b")
    empty = sized.where("n = 0").select("cluster", "card_id")
    bare = empty.join(empty.groupBy("cluster").agg(F.min("card_id").alias("b")), "cluster").where("card_id <> b").select(F.col("card_id").alias("a"), "b")
    return alike.union(bare)


def decide(members: DataFrame, details: Sequence[DataFrame] = (), put: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """One row for each (cluster, sub): the winner, the figures of the rules, ``decision`` and ``skip_reason``.

    ``members``: cluster, sub, card_id, tag, markup, score.  The first rule that holds decides.  Tags and mark-up are
    looked at only where a card has peers; if they come in tables of their own (``details``, each with one row a card_id),
    only those cards' rows are read out of them, and ``put`` stores the list of them, whose size then decides the join.
    """
    part = Window.partitionBy("cluster", "sub")
    order = part.orderBy(F.col("score").desc(), "card_id")
    ranked = members.select("cluster", "sub", "card_id", "score", F.row_number().over(order).alias("rk"), F.lead("score").over(order).alias("runner_up"), F.count("*").over(part).alias("size"))
    win = ranked.where("rk = 1").select("cluster", "sub", "size", F.col("card_id").alias("winner_id"), F.col("score").alias("winner_score"), F.col("runner_up").alias("runner_up_score"))
    several = ranked.where("size > 1").select("cluster", "sub", "card_id", "rk")
    if details:
        several = put(several, "several")
        told, ids = several, several.select("card_id")
        for table in details:
            told = told.join(table.join(ids, "card_id", "left_semi"), "card_id", "left")
    else:
        told = several.join(members.select("cluster", "sub", "card_id", "tag", "markup"), ["cluster", "sub", "card_id"])
    worded = told.select("cluster", "sub", "rk", T.content_words(F.col("tag")).alias("words"), "markup")
    beside = part.orderBy("rk")
    both = worded.select("cluster", "sub", "rk", "words", "markup", F.first("words").over(beside).alias("w_words"), F.first("markup").over(beside).alias("w_markup")).where("rk > 1")
    near = both.select("cluster", "sub", T.jaccard(F.col("w_words"), F.col("words")).alias("tj"), S.jaccard(F.col("w_markup"), F.col("markup")).alias("mj"), S.covers(F.col("w_markup"), F.col("markup")).alias("covered"))
    met = near.groupBy("cluster", "sub").agg(F.min("mj").alias("mj"), F.bool_and("covered").alias("covered"), F.min("tj").alias("tj_min"), F.max("tj").alias("tj_max"))
    keys = ["cluster", "sub", "size", "winner_id", "winner_score", "runner_up_score"]
    one = lambda c: F.coalesce(c, F.lit(1.0)).alias(c)
    seen = win.join(met, ["cluster", "sub"], "left").select(*keys, one("mj"), F.coalesce("covered", F.lit(True)).alias("winner_covers_all"), one("tj_min"), one("tj_max"))
    margin = F.when(F.col("runner_up_score") > 0, F.col("winner_score") / F.greatest("runner_up_score", F.lit(1e-6)))
    floor = F.when(F.col("tj_max") >= TAG_SAME, TIGHT_MARKUP_FLOOR).otherwise(MARKUP_FLOOR)
    reason = (
        F.when(F.col("size") < 2, "singleton")
        .when(F.col("winner_score") < SCORE_FLOOR, "winner below floor")
        .when((F.coalesce(margin, F.lit(float("inf"))) < MARGIN) & (F.col("winner_score") < GOOD_ENOUGH), "margin too tight")
        .when((F.col("mj") < floor) & ~F.col("winner_covers_all"), "markup differs")
        .when(F.col("tj_min") < TAG_FLOOR, "tags differ")
    )
    three = lambda c: F.bround(c, 3)
    return seen.select(*keys, three(margin).alias("margin"), three("mj").alias("min_markup_jaccard"), "winner_covers_all", three("tj_min").alias("min_tag_jaccard"), three("tj_max").alias("max_tag_jaccard"), floor.alias("markup_floor"), F.when(reason.isNull(), "apply").otherwise("skip").alias("decision"), reason.alias("skip_reason"))


def summary(decisions: DataFrame) -> DataFrame:
    """The report's head: clusters, parts, singletons, applied, skipped, cards to hide."""
    apply = F.col("decision") == "apply"
    return decisions.agg(
        F.count_distinct("cluster").alias("coarse_clusters"), F.count("*").alias("sub_clusters"), F.count_if(F.col("size") == 1).alias("singletons"),
        F.count_if(apply).alias("apply"), F.count_if(~apply).alias("skip"), F.sum(F.when(apply, F.col("size") - 1).otherwise(0)).alias("cards_to_hide"),
    )


def apply_plan(cards: DataFrame, plan: DataFrame, put: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``cards`` with losers pointed at winners and winners visible; ``plan``: loser_id, winner_id.

    A loser of several rows goes to the smallest winner; who wins one row and loses
    another is a loser.  Every pointer then goes to the end of its chain, those of cards
    that pointed at a loser too.
    """
    told = plan.where("loser_id <> winner_id").groupBy(F.col("loser_id").alias("_l")).agg(F.min("winner_id").alias("_w"))
    wins = plan.select(F.col("winner_id").alias("_win")).distinct()
    out = cards.join(told, F.col("card_id") == F.col("_l"), "left").join(wins, F.col("card_id") == F.col("_win"), "left")
    new = F.when(F.col("_win").isNotNull() & F.col("_l").isNull(), F.lit(None)).otherwise(F.coalesce("_w", "canonical_card_id"))
    return repointed(out.withColumn("canonical_card_id", new).drop("_l", "_w", "_win"), put)


def repointed(cards: DataFrame, put: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``cards`` with every pointer at the end of its chain."""
    flat = flatten_chains(cards.select("card_id", "canonical_card_id"), put).select(F.col("card_id").alias("_id"), F.col("canonical_card_id").alias("_end"))
    return cards.join(flat, F.col("card_id") == F.col("_id"), "left").withColumn("canonical_card_id", F.col("_end")).select(cards.columns)


def flatten_chains(cards: DataFrame, put: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``card_id, canonical_card_id`` with every pointer at the end of its chain, by pointer jumping.

    Each round doubles the length of the chain that is covered, so log2 of the number of
    cards is enough; without cycles the rounds end when nothing moves.  A card whose chain
    runs into a cycle points at the smallest card seen on it, which is visible.  ``put``
    stores a round's table where all executors see it and returns it read back.
    """
    now = put(cards.select("card_id", F.col("canonical_card_id").alias("to"), F.col("canonical_card_id").alias("least")), "chain-0")
    for k in range(1, max(1, now.count()).bit_length() + 2):
        nxt = now.select(F.col("card_id").alias("c"), F.col("to").alias("t2"), F.col("least").alias("l2"))
        step = now.join(nxt, F.col("to") == F.col("c"), "left")
        moved = put(step.select("card_id", F.coalesce("t2", "to").alias("to"), F.least("least", "l2").alias("least"), F.col("t2").isNotNull().alias("moved")), f"chain-{k}")
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    # a pointer that still leads on after all rounds is on a cycle
    on = now.select(F.col("card_id").alias("e"), F.col("to").isNotNull().alias("leads_on"))
    out = now.join(on, F.col("to") == F.col("e"), "left")
    cyclic = F.coalesce("leads_on", F.lit(False))
    return out.select("card_id", F.when(~cyclic, F.col("to")).when(F.col("least") < F.col("card_id"), F.col("least")).alias("canonical_card_id"))


def alternates(cards: DataFrame, card_id: int) -> DataFrame:
    """Cards that point at a card, and the card that it points at itself."""
    mine = cards.where(F.col("card_id") == card_id).select(F.col("canonical_card_id").alias("c"))
    up = cards.join(mine, F.col("card_id") == F.col("c"), "left_semi").withColumn("relation", F.lit("canonical"))
    down = cards.where(F.col("canonical_card_id") == card_id).withColumn("relation", F.lit("alternate"))
    return up.union(down)
