"""Changes as joins: each function takes the old rows and the change, and returns the new rows.

Nothing is updated in place; callers write the result to a fresh path and swap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import spans as S
from marginalia.operators.dedup import repointed


def number_from(rows: DataFrame, top: int, order: list[str], id_col: str, prefix: int = 3) -> DataFrame:
    """New ids after ``top`` in the given order, the first column of which is a string.

    Strings sort by their first characters first, so rows are numbered within each
    prefix, and a prefix starts after the rows of all smaller ones: only the counts by
    prefix meet in one task.
    """
    part = rows.withColumn("_pre", F.substring(F.coalesce(F.col(order[0]), F.lit("")), 1, prefix)).withColumn("_null", F.col(order[0]).isNotNull())
    counts = part.groupBy("_null", "_pre").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_null", "_pre")) - F.col("_n")).drop("_n")
    nth = F.row_number().over(Window.partitionBy("_null", "_pre").orderBy(*order))
    return part.withColumn("_nth", nth).join(before, ["_null", "_pre"]).withColumn(id_col, F.lit(top) + F.col("_before") + F.col("_nth")).drop("_null", "_pre", "_nth", "_before")


def get_or_create(old: DataFrame, wanted: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """``old`` and a new row for each distinct key that it lacks; null keys equal each other.  Repeated old keys keep the smallest id."""
    have = old.groupBy(*keys).agg(F.min(id_col).alias(id_col))
    top = old.agg(F.max(id_col)).first()[0] or 0
    same = [have[k].eqNullSafe(F.col(f"_w_{k}")) for k in keys]
    asked = wanted.select(*(F.col(k).alias(f"_w_{k}") for k in keys)).distinct()
    on = same[0]
    for s in same[1:]:
        on = on & s
    new = asked.join(have, on, "left_anti").select(*(F.col(f"_w_{k}").alias(k) for k in keys))
    return have.select(*keys, id_col).unionByName(number_from(new, top, keys, id_col).select(*keys, id_col))


def upsert_seen(old: DataFrame, snapshot: DataFrame, key: str = "file_sha256") -> DataFrame:
    """``key, first_seen, last_seen`` after a snapshot (key, seen): the first only moves back, the last only forward."""
    rows = old.select(key, "first_seen", "last_seen").unionByName(snapshot.select(key, F.col("seen").alias("first_seen"), F.col("seen").alias("last_seen")))
    return rows.groupBy(key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def approve(links: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Chosen proposed links become approved; others stay."""
    hit = chosen.select(*keys).distinct().withColumn("_hit", F.lit(True))
    out = links.join(hit, keys, "left")
    return out.withColumn("status", F.when(F.col("_hit") & (F.col("status") == "proposed"), "approved").otherwise(F.col("status"))).drop("_hit")


def reject(links: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Chosen links go if they are proposed; approved ones stay."""
    hit = chosen.select(*keys).distinct().withColumn("_hit", F.lit(True))
    out = links.join(hit, keys, "left")
    return out.where(~(F.coalesce("_hit", F.lit(False)) & (F.col("status") == "proposed"))).drop("_hit")


def replace_proposed(links: DataFrame, told: DataFrame, asked: DataFrame, card: str = "card_id", tag: str = "tag_id", clear_on_empty: bool = True) -> DataFrame:
    """The asked cards' proposals replaced by ``told``; approved links stay and aren't doubled.

    With ``clear_on_empty`` off, a card for which nothing was told keeps its old proposals.
    """
    scope = asked.select(card).distinct()
    if not clear_on_empty:
        scope = scope.join(told.select(card).distinct(), card, "left_semi")
    scope = scope.withColumn("_in", F.lit(True))
    kept = links.join(scope, card, "left").where(F.col("_in").isNull() | (F.col("status") == "approved")).select(card, tag, "status")
    fresh = told.select(card, tag).distinct().join(asked.select(card).distinct(), card, "left_semi").join(kept.select(card, tag), [card, tag], "left_anti")
    return kept.unionByName(fresh.withColumn("status", F.lit("proposed")))


def retag(links: DataFrame, told: DataFrame, card: str = "card_id", tag: str = "tag_id") -> DataFrame:
    """``told``: card, old tag, ``action`` keep, retag or remove, and ``new_tag``; a retag approves the new link and drops the old."""
    acts = told.where("action in ('retag', 'remove')").select(card, F.col(tag).alias(tag)).distinct().withColumn("_gone", F.lit(True))
    left = links.join(acts, [card, tag], "left").where("_gone is null").select(card, tag, "status")
    fresh = told.where("action = 'retag' and new_tag is not null").select(card, F.col("new_tag").alias(tag), F.lit("approved").alias("status"))
    both = left.unionByName(fresh)
    return both.groupBy(card, tag).agg(F.min("status").alias("status"))  # approved sorts before proposed


def rewrite_tags(cards: DataFrame, told: DataFrame) -> DataFrame:
    """New tags for the cards of ``told`` (card_id, new_tag); their mark-up is cleared.  Of several tags for a card the first in order counts."""
    t = told.groupBy(F.col("card_id").alias("_c")).agg(F.min("new_tag").alias("new_tag"))
    out = cards.join(t, F.col("card_id") == F.col("_c"), "left")
    changed = F.col("new_tag").isNotNull()
    return out.withColumn("tag", F.coalesce("new_tag", "tag")).withColumn("tag_markup", F.when(~changed, F.col("tag_markup"))).drop("_c", "new_tag")


def adopt_markup(cards: DataFrame, wishes: DataFrame) -> DataFrame:
    """Mark-up of duplicates added to their canonical cards; ``wishes``: target_id, donor_id.

    Only a visible target, only a duplicate that points at it, only the same text.
    """
    target = cards.where("canonical_card_id is null").select(F.col("card_id").alias("target_id"), F.col("card_text").alias("_t"))
    donor = cards.select(F.col("card_id").alias("donor_id"), F.col("canonical_card_id").alias("_to"), F.col("card_text").alias("_d"), F.col("markup").alias("_m"))
    fit = wishes.join(target, "target_id").join(donor, "donor_id").where((F.col("_to") == F.col("target_id")) & F.col("_t").eqNullSafe(F.col("_d")))
    given = fit.groupBy(F.col("target_id").alias("_id")).agg(F.flatten(F.collect_list(S.or_none(F.col("_m")))).alias("_all"))
    out = cards.join(given, F.col("card_id") == F.col("_id"), "left")
    return out.withColumn("markup", F.when(F.col("_all").isNotNull(), S.union(F.col("markup"), F.col("_all"))).otherwise(F.col("markup"))).drop("_id", "_all")


def set_canonical(cards: DataFrame, wish: DataFrame, put: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``wish``: card_id, target (null makes it visible).  Cards that pointed at a demoted card follow it; the target becomes visible.

    Of several wishes for a card the smallest target counts.  A target that is demoted
    itself leads on: every pointer goes to the end of its chain.
    """
    w = wish.groupBy(F.col("card_id").alias("_c")).agg(F.min("target").alias("_t")).withColumn("_said", F.lit(True))
    tops = w.where("_t is not null").select(F.col("_t").alias("_top")).distinct()
    out = cards.join(w, F.col("card_id") == F.col("_c"), "left").join(tops, F.col("card_id") == F.col("_top"), "left")
    new = F.when(F.col("_said"), F.col("_t")).when(F.col("_top").isNotNull(), F.lit(None)).otherwise(F.col("canonical_card_id"))
    return repointed(out.withColumn("canonical_card_id", new).drop("_c", "_t", "_said", "_top"), put)


def exclude_from_dedup(cards: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select(F.col("card_id").alias("_x")).distinct()
    out = cards.join(hit, F.col("card_id") == F.col("_x"), "left")
    return out.withColumn("dedup_excluded", F.coalesce("dedup_excluded", F.lit(False)) | F.col("_x").isNotNull()).drop("_x")


def edit_variant(variants: DataFrame, edits: DataFrame, cards: DataFrame) -> DataFrame:
    """Mark-up edits on list variants; the first edit of a card makes its variant from the card's own mark-up.

    ``edits``: workspace_id, card_id, action, start, end, kind; one an entry.  An edit out
    of the text's bounds, or of an empty range, is left out.
    """
    c = cards.select("card_id", "card_text", F.col("markup").alias("_own"))
    ok = edits.join(c, "card_id").where("start >= 0 and start < end and end <= length(card_text)")
    old = variants.select("workspace_id", "card_id", F.col("markup").alias("_var"))
    made = ok.join(old, ["workspace_id", "card_id"], "left")
    made = made.select("workspace_id", "card_id", S.apply_op(F.coalesce("_var", "_own"), F.col("action"), F.col("start"), F.col("end"), F.col("kind")).alias("markup"))
    return old.join(made.select("workspace_id", "card_id"), ["workspace_id", "card_id"], "left_anti").withColumnRenamed("_var", "markup").unionByName(made)


def last_proposals(rows: DataFrame, existing: DataFrame, slug: str = "slug", batch: str = "batch") -> DataFrame:
    """Vocabulary proposals: the last batch wins for each slug, within it the first by its other columns; known slugs go."""
    w = Window.partitionBy(slug).orderBy(F.col(batch).desc(), *(c for c in rows.columns if c not in (slug, batch)))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn").join(existing.select(slug).distinct(), slug, "left_anti")


def register(users: DataFrame, nickname: str, pw_hash: str) -> DataFrame:
    """Users after a registration: a nickname taken in any case changes nothing; the first account claims the placeholder."""
    nick = nickname.strip()
    taken = not users.where((F.lower("nickname") == nick.lower()) & F.col("pw_hash").isNotNull()).isEmpty()
    if taken:
        return users
    real = not users.where("pw_hash is not null").isEmpty()
    spare = None if real else users.where("pw_hash is null").orderBy("id").select("id").first()
    if spare is not None:
        me = F.col("id") == spare["id"]
        return users.withColumn("nickname", F.when(me, nick).otherwise(F.col("nickname"))).withColumn("pw_hash", F.when(me, pw_hash).otherwise(F.col("pw_hash")))
    top = users.agg(F.max("id")).first()[0] or 0
    row = users.sparkSession.createDataFrame([(top + 1, nick, pw_hash)], "id long, nickname string, pw_hash string")
    return users.select("id", "nickname", "pw_hash").unionByName(row)


def violations(rows: DataFrame, name: str, bad: Column) -> DataFrame:
    """``check, n``: how many rows break a rule."""
    return rows.where(bad).agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")


def repeated_keys(rows: DataFrame, name: str, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("m")).where("m > 1").agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")


def orphans(rows: DataFrame, name: str, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    p = parents.select(F.col(parent_key).alias("_p"))
    return rows.where(F.col(key).isNotNull()).join(p, F.col(key) == F.col("_p"), "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
