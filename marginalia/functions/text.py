"""Scalar functions over strings, as Columns.

All of them are built-in expressions, so they stay inside generated code.  White space
means what Unicode counts as such, the no-break space included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, for Java patterns.
BLANK = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same characters one by one, and a run of others; both are far faster than the class.
BLANKS = " \t\n\x0b\f\r\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"(?U)\S+"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.trim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    """Every stretch of white space as one space."""
    return F.regexp_replace(c, rf"{BLANK}+", " ")


def word_count(c: Column) -> Column:
    """Words between white space; 0 for null and blank."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD))


def identifier(c: Column) -> Column:
    """Lower case, ASCII letters and digits only; null as empty."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def url_normal(c: Column) -> Column:
    """Trimmed and in lower case, without fragment and trailing slashes; the query stays.  Null as empty."""
    return F.regexp_replace(F.substring_index(F.lower(strip(F.coalesce(c, F.lit("")))), "#", 1), "/+$", "")


def html_escape(c: Column) -> Column:
    """The five characters that matter in HTML, the ampersand first."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def header_path(c: Column) -> Column:
    """A path split at the first kind of separator that stands in it; blank parts go."""
    parts = F.when(F.contains(c, F.lit(" > ")), F.split(c, " > "))
    for sep in (" › ", "›", ","):
        parts = parts.when(F.contains(c, F.lit(sep)), F.split(c, sep))
    parts = parts.otherwise(F.array(c))
    return F.filter(F.transform(F.coalesce(parts, F.array().cast("array<string>")), strip), lambda p: p != "")


def heading_side(c: Column) -> Column:
    """A top heading as Neg, Aff, its own text without ``---``, or Other."""
    bare = strip(F.replace(F.coalesce(c, F.lit("")), F.lit("---"), F.lit("")))
    low = F.lower(bare)
    return (
        F.when(F.contains(low, F.lit("negative")) | (low == "neg"), "Neg")
        .when(F.contains(low, F.lit("affirmative")) | (low == "aff"), "Aff")
        .when(bare == "", "Other")
        .otherwise(bare)
    )


def snippet(text: Column, query: Column, length: int = 240, before: int = 60, after: int = 180) -> Column:
    """The text around the first case-insensitive hit, or its start; plain text with ellipses."""
    at = F.instr(F.lower(text), F.lower(query))  # 1-based, 0 if there is none
    hit = F.coalesce(at, F.lit(0)) * F.when(F.coalesce(query, F.lit("")) == "", 0).otherwise(1)
    n = F.length(text)
    lo = F.greatest(F.lit(0), hit - 1 - before)
    hi = F.least(n, hit - 1 + F.length(query) + after)
    around = F.concat(F.when(lo > 0, "…").otherwise(""), F.substring(text, lo + 1, hi - lo), F.when(hi < n, "…").otherwise(""))
    start = F.concat(F.substring(text, 1, length), F.when(n > length, "…").otherwise(""))
    return F.when(hit > 0, around).otherwise(start)


def minutes(seconds: Column) -> Column:
    """``m:ss``; negative counts as zero."""
    s = F.greatest(F.lit(0), seconds).cast("long")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def safe_filename(c: Column, suffix: str = ".docx") -> Column:
    """Letters, digits, dot, dash and underscore kept; other stretches become one underscore."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")
    return F.concat(F.when(bare == "", "workspace").otherwise(bare), F.lit(suffix))


# Pages that a redirect must not lead back to.
ACCOUNT_PAGES = ("/login", "/register", "/logout")


def safe_redirect(c: Column, default: str = "/workspaces") -> Column:
    """A path on this site; other sites, ``//host`` in either slash, and account pages give the default."""
    page = F.regexp_replace(F.substring_index(c, "?", 1), "/+$", "")
    bad = F.startswith(c, F.lit("//")) | F.startswith(c, F.lit("/\\")) | page.isin(*ACCOUNT_PAGES)
    return F.when(c.isNotNull() & F.startswith(c, F.lit("/")) & ~bad, c).otherwise(default)


def shorten(c: Column, most: int) -> Column:
    """Cut to ``most`` characters with an ellipsis."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def breadcrumb(path: Column) -> Column:
    return F.array_join(path, " › ")


# Named rounds of a tournament; sort number and rest of a name, and the two forms of a round.
ROUNDS = ("Finals", "Semifinals", "Semis", "Quarterfinals", "Quarters", "Octofinals", "Octos", "Doubles", "Triples", "Elims", "RR", "Round-Robin")


REST, NUMBERED, NAMED = r"(?s)^(\d{1,3})\.?(?:---|--|-)(.+)$", r"^(.+?)-Round-(\d+)$", rf"(?i)^(.+?)-({'|'.join(ROUNDS)})$"


def disclosure_name(name: Column) -> Column:
    """A struct of school, team, side, tournament, round_name and sort_prefix; null if the name doesn't fit.

    School-Team-Side-rest, the rest with an optional sort number and a round at its end.
    Only a lower-case suffix is taken off.
    """
    stem = F.regexp_replace(name, r"\.docx$", "")
    parts = F.split(stem, "-", 4)
    rest = parts[3]
    numbered = F.regexp_extract(rest, REST, 1)
    body = F.when(numbered != "", F.regexp_extract(rest, REST, 2)).otherwise(rest)
    is_number, is_name = body.rlike(NUMBERED), body.rlike(NAMED)
    spaced = lambda c: F.nullif(strip(F.replace(c, F.lit("-"), F.lit(" "))), F.lit(""))
    tournament = F.when(is_number, F.regexp_extract(body, NUMBERED, 1)).when(is_name, F.regexp_extract(body, NAMED, 1)).otherwise(body)
    round_name = F.when(is_number, F.concat(F.lit("Round "), F.regexp_extract(body, NUMBERED, 2))).when(is_name, F.regexp_extract(body, NAMED, 2))
    fits = (F.size(parts) == 4) & parts[2].isin("Aff", "Neg")
    return F.when(
        fits,
        F.struct(parts[0].alias("school"), parts[1].alias("team"), parts[2].alias("side"), spaced(tournament).alias("tournament"), round_name.alias("round_name"), F.nullif(numbered, F.lit("")).alias("sort_prefix")),
    )


# Words that say nothing about an argument.
STOP_WORDS = "a an the and or of for to in on at is are was were be been being this that these those it its their they them as but by with not no".split()


def content_words(c: Column) -> Column:
    """Distinct lower-case words of more than two letters that aren't stop words."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NAME_WORD), F.lit(0))
    kept = F.filter(F.transform(found, F.lower), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))
    return F.array_distinct(kept)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty, 0 if one is."""
    none_a, none_b = F.size(a) == 0, F.size(b) == 0
    return F.when(none_a & none_b, 1.0).when(none_a | none_b, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def within_unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


# Marks of tags that a parser made, and the shape of a short cite.
BRACKETED, COUNTED, ENDS = r"^\s*\[[^\]]{0,4}\]\s", r"^\s*\d{1,2}[.)\-]\s", (".", "?", "!", "”", '"')
AUTHOR_YEAR = r"^[A-Z][A-Za-z'\-]+(\s+(et al\.?|and\s+[A-Z][A-Za-z'\-]+))?,?\s*'?\d{2,4}"
NAME_WORD = r"[A-Za-z][A-Za-z'\-]+"


#: A whole word of six capitals or more; the first letter is looked for before what stands before it.
CAPITALS = r"[A-Z](?<![\p{L}\p{N}_][A-Z])[A-Z]{5,}+(?![\p{L}\p{N}_])"


def _named(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def tag_quality(tag: Column, source_file: Column) -> Column:
    """How much a tag looks like a written claim, from 0 to 1."""
    stem = F.regexp_replace(F.element_at(F.split(source_file, "/"), -1), r"(?<=.)\.[^.]*$", "")
    bonus = lambda when, x: F.when(when, F.lit(x)).otherwise(0.0)
    length = lambda n: F.when((n >= 6) & (n <= 30), 0.2).when(n < 4, -0.15).when(n > 50, -0.1).otherwise(0.0)

    def scored(tag: Column) -> Column:
        score = (
            F.lit(0.5)
            + bonus(F.contains(tag, F.lit("---")), -0.4)
            + bonus(tag.rlike(BRACKETED), -0.25)
            + bonus(tag.rlike(COUNTED), -0.15)
            + bonus((F.coalesce(source_file, F.lit("")) != "") & (strip(tag) == stem), -0.3)
            + _named(word_count(tag), length)
            + bonus(tag.rlike(r"^\p{Lu}"), 0.05)
            + bonus(F.substring(tag, -1, 1).isin(*ENDS), 0.05)
            + bonus(F.regexp_count(tag, F.lit(CAPITALS)) >= 2, -0.15)
        )
        return F.when(F.coalesce(tag, F.lit("")) == "", 0.0).otherwise(_named(score, within_unit))

    return _named(tag, scored)


def cite_quality(cite: Column, year: Column) -> Column:
    """How much a short cite looks like author and year, from 0 to 1."""
    c = strip(cite)
    shape = c.rlike(AUTHOR_YEAR)
    edge = lambda y: F.concat(F.lit(r"(^|[^A-Za-z0-9_])"), y, F.lit(r"([^A-Za-z0-9_]|$)"))
    short = F.lpad((year % 100).cast("string"), 2, "0")
    agrees = F.coalesce(F.regexp_like(c, edge(short)) | F.regexp_like(c, edge(year.cast("string"))), F.lit(False))
    names = F.size(F.regexp_extract_all(c, F.lit(NAME_WORD), F.lit(0)))
    bonus = lambda when, x: F.when(when, F.lit(x)).otherwise(0.0)
    score = F.lit(0.5) + F.when(shape, 0.3).otherwise(-0.1) + bonus(~c.rlike(r"\d"), -0.2) + bonus(agrees, 0.1) + bonus(names >= 3, 0.07) + bonus(F.length(c) > 60, -0.15) + bonus(F.length(c) < 4, -0.2)
    return F.when(F.coalesce(cite, F.lit("")) == "", 0.0).otherwise(within_unit(score))


# Fixed value: a block label in front of a tag.
BLOCK_LABEL = r"^[A-Z0-9 ]{3,15}---"


def noisy_tag(tag: Column, phrase: str = "insert") -> Column:
    """Tags that a rewrite should look at: leaked markers, a placeholder phrase, or a block label in front."""
    return F.contains(tag, F.lit("<<")) | F.contains(F.lower(tag), F.lit(phrase)) | tag.rlike(BLOCK_LABEL)


# First names that go whatever their length (others go if shorter than eight letters), and the patterns of short cites.
FIRST_NAMES = ("Steve", "Lauren", "Jordan", "Chris", "Mark", "Anna", "Pete", "Tony")
COMMA_SPACE = r"(?U),\s+"
ET_AL = r"(?iU)\bet\.\s+al\b"
TRAILING = r"(?U)[,;\s]+$"
TWO_AUTHORS = r"(?U)\b(\w+)\s+and\s+(\w+)\s*,?\s*(\d)"
FIRST_AND_LAST = r"(?U)^([A-Z][a-z]+)\s+([A-Z][\w'’\-]+(?:\s+(?:&|and|et\s+al\.?)\s+[A-Z][\w'’\-]+)?)\s*[,\s]\s*(\S.*)$"
YEAR_OR_DATE = r"(?U)\s*['’]?\d{1,4}(?:[/\-]\d{1,2}(?:[/\-]\d{2,4})?)?$"


def cleaned_cite(c: Column) -> Column:
    """A short cite in one form: plain spaces, no comma before a space, ``et al.``, no trailing marks, an ampersand between two authors, no first name."""
    c = F.regexp_replace(F.replace(c, F.lit("\u00a0"), F.lit(" ")), COMMA_SPACE, " ")
    c = strip(squeeze(F.regexp_replace(F.regexp_replace(c, ET_AL, "et al."), TRAILING, "")))
    c = F.regexp_replace(c, TWO_AUTHORS, "$1 & $2 $3")
    first = F.regexp_extract(c, FIRST_AND_LAST, 1)
    short = (first != "") & (first.isin(*FIRST_NAMES) | (F.length(first) < 8))
    return F.when(short, strip(F.concat_ws(" ", F.regexp_extract(c, FIRST_AND_LAST, 2), F.regexp_extract(c, FIRST_AND_LAST, 3)))).otherwise(c)


def author_without_year(c: Column) -> Column:
    """The author part of a short cite: a year or a date at its end goes."""
    return strip(F.regexp_replace(c, YEAR_OR_DATE, ""))


def valid_nickname(c: Column) -> Column:
    bare = strip(c)
    return F.coalesce((F.length(bare) >= 1) & (F.length(bare) <= 32) & ~bare.rlike(BLANK), F.lit(False))


def valid_password(c: Column, least: int = 8) -> Column:
    return F.coalesce(F.length(c) >= least, F.lit(False))
