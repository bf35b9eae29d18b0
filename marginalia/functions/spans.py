"""Interval algebra over mark-up: arrays of (start, end, kind), offsets in code points, half open.

Everything is a Column over one row's arrays, so no row is exploded and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import html_escape, word_count

SPANS = "array<struct<start int, end int, kind string>>"
#: Words a minute of the reading-time estimate.
WPM = 270


def span(start: Column | int, end: Column | int, kind: Column | str) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_col(start).cast("int").alias("start"), as_col(end).cast("int").alias("end"), as_col(kind).cast("string").alias("kind"))


def or_none(spans: Column) -> Column:
    return F.coalesce(spans, F.array().cast(SPANS))


def normalize(spans: Column) -> Column:
    """Spans of one kind that touch or overlap become one; empty ones go; by start, then kind."""
    kept = F.array_sort(F.transform(F.filter(or_none(spans), lambda s: s["start"] < s["end"]), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))

    def step(done: Column, s: Column) -> Column:
        top = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["kind"] == s["kind"]) & (s["start"] <= F.try_element_at(done, F.lit(-1))["end"])
        grown = F.struct(top["kind"].alias("kind"), top["start"].alias("start"), F.greatest(top["end"], s["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(s)))

    merged = F.aggregate(kept, F.array().cast("array<struct<kind string, start int, end int>>"), step)
    back = F.array_sort(F.transform(merged, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.transform(back, lambda s: span(s["start"], s["end"], s["kind"]))


def subtract(spans: Column, lo: Column, hi: Column) -> Column:
    """Without [lo, hi): spans across an edge are cut, spans around it become two."""
    parts = lambda s: F.filter(F.array(span(s["start"], F.least(s["end"], lo), s["kind"]), span(F.greatest(s["start"], hi), s["end"], s["kind"])), lambda p: p["start"] < p["end"])
    apart = lambda s: (s["end"] <= lo) | (s["start"] >= hi)
    return F.flatten(F.transform(or_none(spans), lambda s: F.when(apart(s), F.array(span(s["start"], s["end"], s["kind"]))).otherwise(parts(s))))


def union(*many: Column) -> Column:
    """All spans of all lists, normalised."""
    return normalize(F.concat(*(or_none(m) for m in many)))


def apply_op(spans: Column, action: Column, lo: Column, hi: Column, kind: Column) -> Column:
    """``add`` a kind over [lo, hi), a highlight with its underline, or ``clear`` the range; an empty range changes nothing."""
    line, light = F.array(span(lo, hi, "underline")), F.array(span(lo, hi, "highlight"))
    added = F.when(kind == "highlight", F.concat(or_none(spans), line, light)).otherwise(F.concat(or_none(spans), line))
    return F.when(lo >= hi, or_none(spans)).when(action == "clear", normalize(subtract(spans, lo, hi))).otherwise(normalize(added))


def jaccard(a: Column, b: Column) -> Column:
    """Over the raw triples; 1 if both lists are empty, 0 if one is."""
    x, y = F.array_distinct(or_none(a)), F.array_distinct(or_none(b))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def covers(winner: Column, loser: Column) -> Column:
    """Whether every span of the second lies inside one of the first of its kind."""
    w = or_none(winner)
    return F.forall(or_none(loser), lambda x: F.exists(w, lambda y: (y["kind"] == x["kind"]) & (y["start"] <= x["start"]) & (y["end"] >= x["end"])))


def of_kind(spans: Column, kind: str) -> Column:
    """Non-empty spans of a kind by start; spans of equal start keep their order."""
    hit = F.filter(or_none(spans), lambda s: (s["kind"] == kind) & (s["start"] < s["end"]))
    numbered = F.transform(hit, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), s["end"].alias("end")))
    return F.transform(F.sort_array(numbered), lambda s: span(s["start"], s["end"], F.lit(kind)))


def cut(text: Column, s: Column) -> Column:
    return F.substring(text, s["start"] + 1, s["end"] - s["start"])


def reading_text(text: Column, spans: Column) -> Column:
    """The highlighted parts by start, joined by spaces."""
    return F.array_join(F.transform(of_kind(spans, "highlight"), lambda s: cut(text, s)), " ")


def reading_words(text: Column, spans: Column) -> Column:
    return word_count(reading_text(text, spans))


def reading_seconds(words: Column, wpm: int = WPM) -> Column:
    """Half to even; at least 1 for any word."""
    return F.when(words == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.bround(words * 60 / wpm).cast("long")))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named: inside lambdas nothing else sees to that."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _all_of_kind(s: Column, kind: str) -> Column:
    return F.filter(s, lambda x: x["kind"] == kind)


def _edges(length: Column, s: Column) -> Column:
    """Where a text of this length begins and ends and where spans do, in order, each once."""
    ends = F.array_distinct(F.concat(F.array(F.lit(0), length), F.transform(s, lambda x: x["start"]), F.transform(s, lambda x: x["end"])))
    null_last = lambda e: F.concat(F.slice(e, F.lit(2), F.size(e)), F.slice(e, F.lit(1), F.lit(1)))
    return _let(F.sort_array(ends), lambda e: F.when(F.get(e, F.lit(0)).isNull(), null_last(e)).otherwise(e))


def segments(text: Column, spans: Column) -> Column:
    """The text cut at every end of a span: structs of start, end, highlighted and underlined."""
    pairs = lambda e: F.zip_with(F.slice(e, F.lit(1), F.greatest(F.size(e) - 1, F.lit(0))), F.slice(e, F.lit(2), F.size(e)), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    has = lambda p, s: F.exists(s, lambda x: (x["start"] <= p["start"]) & (x["end"] >= p["end"]))
    told = lambda s, lights, lines: F.transform(_let(_edges(F.length(text), s), pairs), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), has(p, lights).alias("highlighted"), has(p, lines).alias("underlined")))
    return _let(or_none(spans), lambda s: _let(_all_of_kind(s, "highlight"), lambda lights: _let(_all_of_kind(s, "underline"), lambda lines: told(s, lights, lines))))


DOTS = ' <span class="ellipsis">…</span> '


def _rendered(text: Column, s: Column, lights: Column, lines: Column) -> Column:
    """The text cut at the ends of the spans ``s``; ``lights`` and ``lines`` are those of them that highlight and underline."""

    def part(e: Column, x: Column, i: Column) -> Column:
        chunk = html_escape(F.substring(text, x + 1, F.get(e, i + 1) - x))  # null after the last end, and so left out
        on = lambda s: F.exists(s, lambda y: (y["start"] <= x) & (y["end"] > x))  # noqa: E731  # no span ends before the next edge
        lit = F.concat(F.lit('<mark class="hl">'), chunk, F.lit("</mark>"))
        under = F.concat(F.lit('<u class="ul">'), chunk, F.lit("</u>"))
        return F.when(on(lights), lit).when(on(lines), under).otherwise(chunk)

    return _let(_edges(F.length(text), s), lambda e: F.array_join(F.transform(e, lambda x, i: part(e, x, i)), ""))


def render_full(text: Column, spans: Column) -> Column:
    return _let(or_none(spans), lambda s: _let(_all_of_kind(s, "highlight"), lambda lights: _let(_all_of_kind(s, "underline"), lambda lines: _rendered(text, s, lights, lines))))


def render(text: Column, spans: Column, mode: str = "full") -> Column:
    """HTML of a passage: full, highlight-only, underline-only or plain."""
    if mode == "plain":
        return html_escape(text)
    if mode == "full":
        return render_full(text, spans)
    if mode == "highlight-only":
        return F.array_join(F.transform(of_kind(spans, "highlight"), lambda s: F.concat(F.lit('<mark class="hl">'), html_escape(cut(text, s)), F.lit("</mark>"))), DOTS)
    if mode != "underline-only":
        raise ValueError(f"unknown mode {mode!r}")

    def clipped(lights: Column, u: Column) -> Column:
        inside = F.transform(lights, lambda h: span(F.greatest(h["start"], u["start"]) - u["start"], F.least(h["end"], u["end"]) - u["start"], "highlight"))
        return F.filter(inside, lambda c: c["start"] < c["end"])

    def line(lights: Column, u: Column) -> Column:
        whole = F.array(span(F.lit(0), u["end"] - u["start"], "underline"))
        return _let(cut(text, u), lambda t: _let(clipped(lights, u), lambda h: _let(whole, lambda w: _rendered(t, F.concat(w, h), h, w))))

    return _let(_all_of_kind(or_none(spans), "highlight"), lambda lights: F.array_join(F.transform(of_kind(spans, "underline"), lambda u: line(lights, u)), DOTS))
