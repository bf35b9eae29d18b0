"""Joins of intervals on a key: which lie inside others, and which overlap.

An interval [start, end) stands in the bins of the width that fits it, the smallest power of
eight that isn't below its length; so it touches two bins at most, however long it is.  Of
two intervals that overlap the one of the smaller width also asks in the bins of the other's
width, where it again touches two at most.  So no interval is laid out over many small bins:
it has two rows for each width that occurs, its own and larger ones.  An equi-join on key,
width and bin brings candidates together, and the bounds decide.  A pair comes from one
bin, the first that both touch.

Widths of which there is no interval aren't asked for: they are found first, one row each.
Rows with a null key or bound join nothing, nor do empty intervals.  A key with a third of
all rows is cut by its bins; a bin with very many intervals is a skewed join key, which
adaptive execution splits, for both sides come straight from an exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits by which each width exceeds the one below it, and those of the largest.
BITS, MOST = 3, 60


def width(start: Column, end: Column) -> Column:
    """Bits of the smallest width that isn't below the interval's length."""
    out = F.lit(MOST)
    for bits in reversed(range(0, MOST, BITS)):
        out = F.when(end - start <= (1 << bits), bits).otherwise(out)
    return out


def _bin(at: Column, bits: Column) -> Column:
    return F.call_function("shiftright", at, bits)


def _named(rows: DataFrame, keys: tuple[str, str, str], side: str) -> DataFrame:
    key, start, end = keys
    ok = rows.where(F.col(key).isNotNull() & (F.col(start) < F.col(end)))
    out = ok.select(*(F.col(c).alias(f"{c}_{side}") for c in ok.columns), F.col(key).alias("_key"), F.col(start).cast("long").alias(f"_s_{side}"), F.col(end).cast("long").alias(f"_e_{side}"))
    return out.withColumn(f"_w_{side}", width(F.col(f"_s_{side}"), F.col(f"_e_{side}")))


def _placed(rows: DataFrame, side: str, widths: Column) -> DataFrame:
    """``rows`` once for each of ``widths`` and each bin of it that they touch."""
    out = rows.withColumn("_width", F.explode(widths))
    return out.withColumn("_bin", F.explode(F.sequence(_bin(F.col(f"_s_{side}"), F.col("_width")), _bin(F.col(f"_e_{side}") - 1, F.col("_width")))))


def _met(small: DataFrame, s: str, large: DataFrame, t: str, wider: bool) -> DataFrame:
    """Rows of ``small`` and of ``large`` that touch a common bin of the latter's width, which is as wide at least or, with ``wider``, wider."""
    every = sorted(r[0] for r in large.select(f"_w_{t}").distinct().collect())  # one for each width
    own = F.col(f"_w_{s}")
    asked = F.filter(F.array(*map(F.lit, every)).cast("array<int>"), lambda w: w > own if wider else w >= own)
    both = _placed(small, s, asked).join(_placed(large, t, F.array(f"_w_{t}")), ["_key", "_width", "_bin"])
    first = F.greatest(_bin(F.col(f"_s_{s}"), F.col("_width")), _bin(F.col(f"_s_{t}"), F.col("_width")))
    return both.where(F.col("_bin") == first).drop("_width", "_bin")


def contained(inner: DataFrame, outer: DataFrame, key: str = "key", start: str = "start", end: str = "end") -> DataFrame:
    """Each row of ``inner`` with each row of ``outer`` of its key that covers it whole; their columns get ``_a`` and ``_b``."""
    a, b = _named(inner, (key, start, end), "a"), _named(outer, (key, start, end), "b")
    covers = (F.col("_s_b") <= F.col("_s_a")) & (F.col("_e_a") <= F.col("_e_b"))
    return _met(a, "a", b, "b", False).where(covers).select([f"{c}_a" for c in inner.columns] + [f"{c}_b" for c in outer.columns])


def overlapping(left: DataFrame, right: DataFrame, key: str = "key", start: str = "start", end: str = "end") -> DataFrame:
    """Each row of ``left`` with each row of ``right`` of its key that it shares a place with; their columns get ``_a`` and ``_b``."""
    a, b = _named(left, (key, start, end), "a"), _named(right, (key, start, end), "b")
    shares = (F.col("_s_a") < F.col("_e_b")) & (F.col("_s_b") < F.col("_e_a"))
    columns = [f"{c}_a" for c in left.columns] + [f"{c}_b" for c in right.columns]
    met = _met(a, "a", b, "b", False), _met(b, "b", a, "a", True)
    return met[0].where(shares).select(columns).union(met[1].where(shares).select(columns))


def clipped(left: DataFrame, right: DataFrame, key: str = "key", start: str = "start", end: str = "end") -> DataFrame:
    """The overlaps, with ``clip_start, clip_end``: the shared part, counted from the start of the right interval."""
    out = overlapping(left, right, key, start, end)
    base = F.col(f"{start}_b")
    return out.withColumn("clip_start", F.greatest(f"{start}_a", f"{start}_b") - base).withColumn("clip_end", F.least(f"{end}_a", f"{end}_b") - base)
