"""From files to rows: paragraphs, items, cites, mark-up and tags in one chain, and the inserts.

A file's paragraphs are cut into items; each item's body, mark-up, header path, cite and
tags are worked out, and cards without a body are dropped.  Files that are no documents
are reported with their error and give no rows; the other files aren't held up by them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import cites
from marginalia.functions import spans as S
from marginalia.functions import text as T
from marginalia.operators import changes as C
from marginalia.operators import segment as G
from marginalia.operators.tagging import Rules, infer_tags
from marginalia.sources import docx


@dataclass
class Extracted:
    """``items``: a row for each card and argument; ``errors``: path, error of files that can't be read."""

    items: DataFrame
    errors: DataFrame


def marked(runs: Column) -> Column:
    """The mark-up of one paragraph's runs."""
    return G.join_touching(G.run_spans(runs, F.lit(0)))


def extract(files: DataFrame, rules: Rules = (), skip_empty: bool = True) -> Extracted:
    """Items of Word files (path, content), with the tags of the rules; nothing is stored yet.

    Edge cases: empty paragraphs end up in no text; a card whose body is blank is left out
    (``skip_empty``); an item's path has the side of its first heading, then the others.
    """
    rows = docx.paragraphs(files).withColumnRenamed("path", "file")
    found = G.items(rows.select("file", "idx", "style", "text", (F.size("runs") > 0).alias("has_runs")))
    upto = Window.partitionBy("file").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = found.withColumnRenamed("tag_idx", "idx").select("file", "idx", F.struct("kind", F.col("idx").alias("tag_idx"), "cite_idx", "body_start", "body_end", "h1", "h2", "h3").alias("own"))
    placed = rows.join(starts, ["file", "idx"], "left").withColumn("item", F.last("own", True).over(upto)).where("item is not null")
    is_tag, is_cite = F.col("idx") == F.col("item.tag_idx"), F.col("idx") == F.col("item.cite_idx")
    in_body = F.col("idx").between(F.col("item.body_start"), F.col("item.body_end"))
    part = F.struct("idx", "text", "runs")
    told = placed.groupBy("file", "item").agg(
        F.max(F.when(is_tag, F.struct("text", "runs"))).alias("tag"),
        F.max(F.when(is_cite, F.col("text"))).alias("cite_text"),
        F.array_sort(F.collect_list(F.when(in_body, part))).alias("body"),
    )
    whole = lambda runs: F.array_join(F.transform(runs, lambda r: F.coalesce(r["text"], F.lit(""))), "")
    name = F.element_at(F.split("file", "/"), -1)
    made = told.select(
        "file", name.alias("source_file"), "item.*", whole(F.col("tag.runs")).alias("tag"), marked(F.col("tag.runs")).alias("tag_markup"), "cite_text",
        G.body(F.transform("body", lambda p: F.struct(p["text"].alias("text"), p["runs"].alias("runs")))).alias("_b"),
    )
    card = F.col("kind") == "card"
    empty = F.array().cast(S.SPANS)
    path = F.array_compact(F.concat(F.array(T.heading_side(F.col("h1"))), F.filter(F.array("h2", "h3"), lambda h: F.coalesce(h, F.lit("")) != "")))
    tags = infer_tags(F.col("tag"), F.col("h1"), F.col("h2"), F.col("h3"), F.col("source_file"), rules) if rules else F.array().cast("array<string>")
    out = made.select(
        "file", "source_file", "kind", "tag_idx", "tag", "tag_markup", F.when(card, F.col("cite_text")).alias("cite_text"), F.when(card, cites.parse_cite(F.col("cite_text"))).alias("source"),
        F.when(card, F.col("_b.text")).alias("card_text"), F.when(card, F.col("_b.markup")).otherwise(empty).alias("markup"),
        F.when(~card, F.coalesce(F.nullif("h2", F.lit("")), F.col("h3"))).alias("answer_to"), path.alias("block_path"), tags.alias("tags"),
    )
    kept = out.where(~card | (T.strip(F.coalesce("card_text", F.lit(""))) != "")) if skip_empty else out
    return Extracted(kept, docx.unreadable(files))


@dataclass
class Inserted:
    """The tables after an ingest: only ``sources`` holds the old rows too."""

    sources: DataFrame
    cards: DataFrame
    analyticals: DataFrame
    links: DataFrame


def insert(items: DataFrame, sources: DataFrame, top_card: int = 0, top_analytical: int = 0, topic_id: int | None = None, upload_id: int | None = None, status: str = "approved", now: Column | None = None) -> Inserted:
    """New rows for extracted items, numbered after the tops by file and place.

    ``sources``: source_id, cite_short, raw_cite; missing ones are made.  Each card and
    argument gets a link for each of its tags, with the given status, and the stamp ``now``.
    """
    stamp = F.current_timestamp() if now is None else now
    wanted = items.where("kind = 'card'").select(F.col("source.cite_short").alias("cite_short"), F.col("cite_text").alias("raw_cite"))
    known = C.get_or_create(sources.select("source_id", "cite_short", "raw_cite"), wanted, ["cite_short", "raw_cite"], "source_id")
    common = [F.lit(topic_id).cast("long").alias("topic_id"), F.lit(upload_id).cast("long").alias("wiki_upload_id"), stamp.alias("created_at")]
    cards = C.number_from(items.where("kind = 'card'"), top_card, ["source_file", "tag_idx"], "card_id")
    told = known.select(F.col("source_id"), F.col("cite_short").alias("_c"), F.col("raw_cite").alias("_r"))
    cards = cards.join(told, F.col("source.cite_short").eqNullSafe(F.col("_c")) & F.col("cite_text").eqNullSafe(F.col("_r")), "left")
    arguments = C.number_from(items.where("kind = 'analytical'"), top_analytical, ["source_file", "tag_idx"], "analytical_id")
    links = cards.select("card_id", F.lit(None).cast("long").alias("analytical_id"), F.explode("tags").alias("slug")).union(arguments.select(F.lit(None).cast("long"), "analytical_id", F.explode("tags")))
    return Inserted(
        known,
        cards.select("card_id", "source_id", "source_file", "tag_idx", "tag", "tag_markup", "card_text", "markup", "block_path", *common),
        arguments.select("analytical_id", "source_file", "tag_idx", F.col("tag").alias("argument"), F.col("tag_markup").alias("argument_markup"), "answer_to", "block_path", *common),
        links.withColumn("status", F.lit(status)),
    )
