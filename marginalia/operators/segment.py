"""Document segmentation: paragraphs to items, by a walk over each file.

A fourth-level heading opens an item.  Items with a cite paragraph are cards, those
whose next paragraph is a heading of a higher level are analyticals.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import spans as S
from marginalia.functions.text import strip

# Headers under which plan texts stand.
PLAN_HEADERS = ("plan text", "plan", "advocacy text", "cp text", "perm", "alt text", "advocacy statement")
HEADINGS = tuple(f"Heading {k}" for k in range(1, 5))


def carry_headings(paragraphs: DataFrame, file_col: str = "file") -> DataFrame:
    """With ``h1, h2, h3``: the headings above each paragraph; a new one ends those below it.

    ``items`` differs in one point: a heading that it passes over as part of an item isn't in force.
    """
    w = Window.partitionBy(file_col).orderBy("idx")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = lambda k: F.col("style") == f"Heading {k}"
    title = strip(F.coalesce("text", F.lit("")))
    out = paragraphs.withColumn("_n1", F.count_if(level(1)).over(upto)).withColumn("_n2", F.count_if(level(1) | level(2)).over(upto))
    w2 = Window.partitionBy(file_col, "_n1").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w3 = Window.partitionBy(file_col, "_n2").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("h1", F.last(F.when(level(1), title), True).over(upto)).withColumn("h2", F.last(F.when(level(2), title), True).over(w2)).withColumn("h3", F.last(F.when(level(3), title), True).over(w3))
    return out.drop("_n1", "_n2")


ITEM = "kind string, tag_idx int, cite_idx int, body_start int, body_end int, h1 string, h2 string, h3 string"


def _walk(rows: pd.DataFrame) -> list[tuple]:
    """Items of one file.  An item takes all up to the next heading, so what it passes over opens and titles nothing."""
    rows = rows.sort_values("idx", kind="stable")
    idx, level, filled, title = rows.idx.tolist(), rows.level.tolist(), rows.filled.tolist(), rows.title.tolist()
    n = len(idx)
    content, stop = [n] * (n + 1), [n] * (n + 1)  # from each place on: the next filled paragraph, the next heading
    for i in range(n - 1, -1, -1):
        content[i] = i if filled[i] else content[i + 1]
        stop[i] = i if level[i] else stop[i + 1]
    force: dict[int, str | None] = {1: None, 2: None, 3: None}
    out, i = [], 0
    while i < n:
        k = level[i]
        if k in force:
            force.update({j: title[i] if j == k else None for j in force if j >= k})
        elif k == 4:
            j, tag = content[i + 1], title[i]
            hollow = tag.startswith("(") and tag.endswith(")") and "INSERT" in tag.upper()
            plan = (force[3] or "").strip().lower() in PLAN_HEADERS
            if not (hollow or plan or j == n or level[j] == 4):
                end = stop[j + 1]
                card = not level[j]
                last = idx[end] - 1 if end < n else idx[-1]
                out.append(("card" if card else "analytical", idx[i], *((idx[j], idx[j] + 1, last) if card else (None, None, None)), force[1], force[2], force[3]))
                i = end
                continue
        i += 1
    return out


def items(paragraphs: DataFrame, file_col: str = "file") -> DataFrame:
    """``file, kind, tag_idx, cite_idx, body_start, body_end, h1, h2, h3``; paragraphs: file, idx, style, text, has_runs.

    Whether a heading counts depends on the items before it, and those on the headings, so
    each file is walked once, in one task; only the headings' titles go there.
    """
    bare = strip(F.coalesce("text", F.lit("")))
    level = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, h in enumerate(HEADINGS, 1) for x in (h, k))), F.coalesce("style", F.lit(""))), F.lit(0))
    narrow = paragraphs.select(F.col(file_col).alias("file"), F.col("idx").cast("int").alias("idx"), level.alias("level"), ((bare != "") | F.coalesce("has_runs", F.lit(False))).alias("filled"), F.when(level > 0, bare).otherwise("").alias("title"))
    kind = dict(paragraphs.dtypes)[file_col]
    names = [c.split()[0] for c in ITEM.split(", ")]

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame(_walk(rows), columns=names).astype({c: "Int32" for c in ("tag_idx", "cite_idx", "body_start", "body_end")})
        found.insert(0, "file", key[0])
        return found

    return narrow.groupBy("file").applyInPandas(one, f"file {kind}, {ITEM}").withColumnRenamed("file", file_col)


def run_spans(runs: Column, base: Column) -> Column:
    """Raw spans of a paragraph's runs, from ``base`` on: an underline and a highlight each."""
    start = F.struct(base.cast("int").alias("at"), F.array().cast(S.SPANS).alias("out"))

    def step(acc: Column, r: Column) -> Column:
        end = acc["at"] + F.length(F.coalesce(r["text"], F.lit("")))
        line = F.when(F.coalesce(r["underline"], F.lit("none")) != "none", F.array(S.span(acc["at"], end, "underline"))).otherwise(F.array().cast(S.SPANS))
        light = F.when(r["highlight"].isNotNull() | r["shading"].isNotNull(), F.array(S.span(acc["at"], end, "highlight"))).otherwise(F.array().cast(S.SPANS))
        return F.struct(end.alias("at"), F.concat(acc["out"], line, light).alias("out"))

    return F.aggregate(runs, start, step, lambda acc: acc["out"])


def join_touching(raw: Column) -> Column:
    """The ingest form: underlines, then highlights, in order; a span that starts where the last one ended extends it."""

    def one(kind: str) -> Column:
        def step(done: Column, s: Column) -> Column:
            top = F.try_element_at(done, F.lit(-1))
            grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(S.span(top["start"], s["end"], kind)))
            return F.when((F.size(done) > 0) & (top["end"] == s["start"]), grown).otherwise(F.concat(done, F.array(s)))

        return F.aggregate(F.filter(raw, lambda s: s["kind"] == kind), F.array().cast(S.SPANS), step)

    return F.concat(one("underline"), one("highlight"))


def body(paragraphs: Column) -> Column:
    """``text, markup`` of body paragraphs (array of text and runs, in order); a space only between two letters or digits."""
    empty = F.struct(F.lit("").alias("text"), F.array().cast(S.SPANS).alias("raw"))
    filled = F.filter(paragraphs, lambda p: (strip(F.coalesce(p["text"], F.lit(""))) != "") | (F.size(p["runs"]) > 0))

    def step(acc: Column, p: Column) -> Column:
        glue = F.when(acc["text"].rlike(r"[\p{L}\p{N}]$") & p["text"].rlike(r"^[\p{L}\p{N}]"), F.lit(" ")).otherwise("")
        before = F.concat(acc["text"], glue)
        told = F.array_join(F.transform(p["runs"], lambda r: F.coalesce(r["text"], F.lit(""))), "")
        return F.struct(F.concat(before, told).alias("text"), F.concat(acc["raw"], run_spans(p["runs"], F.length(before))).alias("raw"))

    return F.aggregate(filled, empty, step, lambda acc: F.struct(acc["text"].alias("text"), join_touching(acc["raw"]).alias("markup")))
