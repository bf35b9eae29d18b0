"""Ordered lists: grouping by header, headings from path differences, moves, appends, and commands on whole lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import strip
from marginalia.operators.changes import number_from

#: The name of a list that nobody named.
DEFAULT_NAME = "My Workspace"


def islands(entries: DataFrame, list_col: str, position_col: str, path_col: str) -> DataFrame:
    """``entries`` with ``island``, counted from 1: successive entries of one path share a number."""
    w = Window.partitionBy(list_col).orderBy(position_col)
    changed = (~F.col(path_col).eqNullSafe(F.lag(path_col).over(w))) | (F.row_number().over(w) == 1)
    return entries.withColumn("_changed", changed.cast("int")).withColumn("island", F.sum("_changed").over(w)).drop("_changed")


def common_prefix(a: Column, b: Column) -> Column:
    """How many first elements two arrays share."""
    n = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | ~F.get(a, i).eqNullSafe(F.get(b, i)))
    return F.get(differs, F.lit(0))


def new_headings(entries: DataFrame, list_col: str, position_col: str, path_col: str, deepest: int = 9) -> DataFrame:
    """``list, position, level, heading``: the parts of each path beyond what it shares with the path before."""
    w = Window.partitionBy(list_col).orderBy(position_col)
    none = F.array().cast("array<string>")
    path, before = F.coalesce(F.col(path_col), none), F.coalesce(F.lag(path_col).over(w), none)
    fresh = entries.select(list_col, position_col, path.alias("_p"), before.alias("_b")).withColumn("_n", common_prefix(F.col("_p"), F.col("_b")))
    out = fresh.select(list_col, position_col, "_n", F.posexplode(F.slice("_p", F.col("_n") + 1, F.size("_p"))).alias("_k", "heading"))
    return out.select(list_col, position_col, F.least(F.col("_n") + F.col("_k") + 1, F.lit(deepest)).alias("level"), "heading")


def move(entries: DataFrame, list_col: str, id_col: str, position_col: str, moves: DataFrame) -> DataFrame:
    """All entries of the lists in ``moves`` (list, entry_id, target), numbered from 1 with that entry at the target, clamped."""
    told = moves.select(F.col("list").alias("_l"), "entry_id", "target")
    w = Window.partitionBy(list_col)
    out = entries.join(told, F.col(list_col) == F.col("_l")).withColumn("_is", F.col(id_col) == F.col("entry_id"))
    rank = F.row_number().over(w.orderBy("_is", position_col, id_col))  # the others first, in their order
    n = F.count("*").over(w)
    out = out.withColumn("_rank", rank).withColumn("_n", n)
    to = F.greatest(F.lit(1), F.least("target", "_n"))
    place = F.when(F.col("_is"), to).otherwise(F.when(F.col("_rank") >= to, F.col("_rank") + 1).otherwise(F.col("_rank")))
    return out.withColumn(position_col, place.cast("long")).drop("_l", "entry_id", "target", "_is", "_rank", "_n")


def append(entries: DataFrame, list_col: str, position_col: str, new: DataFrame, order_col: str) -> DataFrame:
    """``new`` rows numbered after the last position of their list; gaps that deletions left stay."""
    top = entries.groupBy(F.col(list_col).alias("_l")).agg(F.max(position_col).alias("_top"))
    nth = F.row_number().over(Window.partitionBy(list_col).orderBy(order_col))
    out = new.withColumn("_nth", nth).join(top, F.col(list_col) == F.col("_l"), "left")
    return out.withColumn(position_col, (F.coalesce("_top", F.lit(0)) + F.col("_nth")).cast("long")).drop("_l", "_top", "_nth")


def remove(entries: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """Without the named entries; positions aren't renumbered."""
    return entries.join(gone.select(F.col(id_col).alias("_g")), F.col(id_col) == F.col("_g"), "left_anti")


def clear(entries: DataFrame, lists: DataFrame, list_col: str = "workspace_id") -> DataFrame:
    """Without any entry of the named lists; the lists themselves stay."""
    return entries.join(lists.select(F.col(list_col).alias("_g")).distinct(), F.col(list_col) == F.col("_g"), "left_anti")


def create(lists: DataFrame, new: DataFrame) -> DataFrame:
    """``lists`` (workspace_id, user_id, name) and those of ``new`` (user_id, name); a blank name becomes the default."""
    top = lists.agg(F.max("workspace_id")).first()[0] or 0
    named = new.select(named_or(F.col("name"), DEFAULT_NAME).alias("name"), "user_id")
    return lists.select("workspace_id", "user_id", "name").unionByName(number_from(named, top, ["name", "user_id"], "workspace_id").select("workspace_id", "user_id", "name"))


def rename(lists: DataFrame, wishes: DataFrame) -> DataFrame:
    """``wishes``: workspace_id, user_id, name.  Only an owner's wish counts, of several the first name in order; a blank name becomes Untitled."""
    told = wishes.groupBy(F.col("workspace_id").alias("_w"), F.col("user_id").alias("_u")).agg(F.min(named_or(F.col("name"), "Untitled")).alias("_n"))
    mine = (F.col("workspace_id") == F.col("_w")) & (F.col("user_id") == F.col("_u"))
    return lists.join(told, mine, "left").withColumn("name", F.coalesce("_n", "name")).drop("_w", "_u", "_n")


def delete(lists: DataFrame, users: DataFrame, wishes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists and users (user_id, current_workspace_id) after ``wishes`` (workspace_id, user_id), of which only an owner's count.

    A user who is left without a list gets a new one; one whose current list went, or who
    had none, gets the first of those left.
    """
    gone = lists.join(wishes.select("workspace_id", "user_id").distinct(), ["workspace_id", "user_id"], "left_semi")
    left = lists.select("workspace_id", "user_id", "name").join(gone.select("workspace_id"), "workspace_id", "left_anti")
    asked = gone.select("user_id").distinct()
    bare = asked.join(left, "user_id", "left_anti").select("user_id", F.lit(DEFAULT_NAME).alias("name"), F.lpad(F.col("user_id").cast("string"), 20, "0").alias("_key"))
    top = lists.agg(F.max("workspace_id")).first()[0] or 0
    kept = left.unionByName(number_from(bare, top, ["_key"], "workspace_id", prefix=17).select("workspace_id", "user_id", "name"))
    first = kept.join(asked, "user_id", "left_semi").groupBy("user_id").agg(F.min("workspace_id").alias("_first"))
    out = users.join(first, "user_id", "left").join(gone.select(F.col("workspace_id").alias("_g")), F.col("current_workspace_id") == F.col("_g"), "left")
    lost = F.col("_g").isNotNull() | F.col("current_workspace_id").isNull()
    return kept, out.withColumn("current_workspace_id", F.when(lost & F.col("_first").isNotNull(), F.col("_first")).otherwise(F.col("current_workspace_id"))).select(users.columns)


def select_list(users: DataFrame, lists: DataFrame, wishes: DataFrame) -> DataFrame:
    """Users with the list of their wish (user_id, workspace_id) as the current one, if it is theirs."""
    own = wishes.join(lists.select("workspace_id", "user_id"), ["workspace_id", "user_id"], "left_semi").groupBy("user_id").agg(F.max("workspace_id").alias("_wish"))
    return users.join(own, "user_id", "left").withColumn("current_workspace_id", F.coalesce("_wish", "current_workspace_id")).select(users.columns)


def named_or(name: Column, otherwise: str) -> Column:
    bare = strip(F.coalesce(name, F.lit("")))
    return F.when(bare == "", F.lit(otherwise)).otherwise(bare)


def revert(entries: DataFrame, variants: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries and variants after the chosen entries (entry_id) went back to their card's own mark-up; their variants go."""
    hit = entries.join(chosen.select("entry_id").distinct(), "entry_id", "left_semi")
    gone = hit.where("variant_id is not null").select(F.col("variant_id").alias("_v")).distinct()
    mark = chosen.select(F.col("entry_id").alias("_e")).distinct()
    out = entries.join(mark, F.col("entry_id") == F.col("_e"), "left").withColumn("variant_id", F.when(F.col("_e").isNull(), F.col("variant_id"))).drop("_e")
    return out, variants.join(gone, F.col("variant_id") == F.col("_v"), "left_anti")


def effective_markup(entries: DataFrame, variants: DataFrame, cards: DataFrame) -> DataFrame:
    """``entry_id, card_id, card_text, markup``: a list's own mark-up where it has one, else the card's."""
    v = variants.select(F.col("variant_id").alias("_v"), F.col("markup").alias("_vm"))
    c = cards.select(F.col("card_id").alias("_c"), "card_text", F.col("markup").alias("_cm"))
    out = entries.join(c, F.col("card_id") == F.col("_c")).join(v, F.col("variant_id") == F.col("_v"), "left")
    return out.select("entry_id", "card_id", "card_text", F.coalesce("_vm", "_cm").alias("markup"))


def exactly_one(a: Column, b: Column) -> Column:
    return a.isNull() != b.isNull()
