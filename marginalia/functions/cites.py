"""Citation parsing: short form, author, year, address, title and qualifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import squeeze, strip

# The shapes of a name, of names in a row, of dates, titles, qualifications and addresses.
NAME = r"[A-Z][\w'’\-]*"
NAMES = rf"{NAME}(?:\s+(?:et\s+al\.?|et\.\s+al\.?|&|and)\s+{NAME})*(?:\s+{NAME})*"
DATE = r"(?:['’]?\d{1,4}|\d{1,2}[/\-]\d{1,2}(?:[/\-]\d{2,4})?|ND|No\s+Date)"
SHORT = rf"(?U)^\s*({NAMES}(?:[,\s]+|—|–){DATE})"
YEAR, SHORT_YEAR, DAY = r"(?:^|[^0-9])(\d{4})(?:[^0-9]|$)", r"['’](\d{2})", r"\b(\d{1,2})[/\-](\d{1,2})[/\-]?(\d{2,4})?"
QUOTED, BRACKETED = '[“"]([^“”"]{8,300})[”"]', r"[(\[]([^()\[\]]{20,1500})[)\]]"
ADDRESS = r"https?://[^\s)\]\\\"<>]+"


def cite_year(c: Column) -> Column:
    """The first year of 1900 to 2030 in four digits; else two digits after an apostrophe; else the year of a date.

    A number's two neighbours belong to it, so of two years parted by one character only the first is seen.
    """
    four = F.filter(F.transform(F.regexp_extract_all(c, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int")), lambda y: y.between(1900, 2030))
    two = F.regexp_extract(c, SHORT_YEAR, 1)
    day = F.regexp_extract(c, DAY, 3)
    number = two.try_cast("int")
    by_two = F.when(number < 50, 2000 + number).otherwise(1900 + number)
    by_day = F.when(F.length(day) == 4, day.try_cast("int")).otherwise(2000 + day.try_cast("int"))
    return F.when(F.size(four) > 0, F.get(four, F.lit(0))).when(two != "", by_two).when(day != "", by_day)


def parse_cite(cite: Column) -> Column:
    """A struct of cite_short, author, year, url, title, qualifications and raw."""
    raw = strip(F.coalesce(cite, F.lit("")))
    plain = F.replace(raw, F.lit("\u00a0"), F.lit(" "))
    matched = F.regexp_extract(plain, SHORT, 1)
    few = F.array_join(F.slice(F.filter(F.split(squeeze(plain), " "), lambda w: w != ""), 1, 4), " ")
    short = F.regexp_replace(squeeze(F.when(matched != "", matched).otherwise(few)), r"^[ ,;]+|[ ,;]+$", "")
    names = F.regexp_replace(F.regexp_extract(plain, rf"(?U)^({NAMES})", 1), r"^[ ,]+|[ ,]+$", "")
    author = F.when(names != "", names).otherwise(F.split(short, " ")[0])
    author = F.regexp_replace(author, r"\s+and\s+", " & ")
    url = F.regexp_replace(F.regexp_extract(raw, ADDRESS, 0), r"[.,;)\\\]]+$", "")
    titles = F.regexp_extract_all(raw, F.lit(QUOTED), F.lit(1))
    longest = F.aggregate(titles, F.lit(""), lambda best, t: F.when(F.length(t) > F.length(best), t).otherwise(best))
    quals = F.replace(F.regexp_extract(raw, BRACKETED, 1), url, F.lit(""))
    for open_, close in (('"', '"'), ("“", "”")):
        quoted = F.concat(F.lit(open_), longest, F.lit(close))
        quals = F.when(longest != "", F.replace(quals, quoted, F.lit(""))).otherwise(quals)
    quals = F.regexp_replace(squeeze(quals), r"^[ ,.;]+|[ ,.;]+$", "")
    known = lambda c: F.when(c == "", "(unknown)").otherwise(c)
    none = lambda c: F.nullif(c, F.lit(""))
    return F.struct(known(short).alias("cite_short"), known(F.coalesce(author, F.lit(""))).alias("author"), cite_year(plain).cast("int").alias("year"), none(url).alias("url"), none(longest).alias("title"), none(quals).alias("qualifications"), raw.alias("raw_cite"))
