"""Hybrid search: postings, a web-style query language, ranking, filters and pages.

A corpus is indexed once into postings (doc_id, term, weight, tf, positions, doc_len);
``save`` stores them by a hash of the term, so that a query reads only the folders and
row groups of its terms.  A query is parsed on the driver into groups of required
alternatives and excluded ones, each a phrase.  The postings of all its terms meet once,
in one row for each document, on which the whole query is decided and ranked.

With ``language="english"`` stop words go and words are stemmed, in the index as in the
query; positions still count every word, so phrases keep their distances.

Rank is the sum over matched query terms of weight * (1 + ln tf) / (1 + ln doc_len).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import vectors
from marginalia.functions.batches import small_batches
from marginalia.functions.stemmer import STOP, stem

PAGE = 50
#: Cosine distance below which a vector match counts.
RADIUS = 0.5
WEIGHTS = {"A": 1.0, "B": 0.4}
#: Folders of a stored index.
BUCKETS = 64
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def postings(docs: DataFrame, id_col: str, fields: dict[str, str], language: str | None = None) -> DataFrame:
    """``doc_id, term, weight, tf, positions, doc_len`` of each term; ``fields`` maps text columns to weight classes."""
    parts = []
    for name, cls in fields.items():
        worded = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(name)).alias("t"))
        parts.append(worded.select("doc_id", F.size("t").alias("n"), F.lit(WEIGHTS[cls]).alias("weight"), F.posexplode("t").alias("pos", "term")))
    every = reduce(DataFrame.union, parts)
    found = every.groupBy("doc_id", "term", "weight").agg(F.sort_array(F.collect_list("pos")).alias("positions"), F.max("n").alias("doc_len"))
    if language:
        stems = stemmed(found, language)
        found = found.join(stems, "term").groupBy("doc_id", F.col("stem").alias("term"), "weight").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"), F.max("doc_len").alias("doc_len"))
    return found.select("doc_id", "term", "weight", F.size("positions").cast("long").alias("tf"), "positions", "doc_len")


#: Postings of an Arrow batch that comes back, and repeated ids from which on they aren't broadcast.
ROWS, REPEATED = 65_536, 500_000
POSTING = "term string, weight double, positions array<int>, doc_len int, longest int"


def every_posting(docs: DataFrame, id_col: str, fields: dict[str, str], language: str | None = None) -> DataFrame:
    """``postings`` with ``longest`` (the most words of a field of the document), for an index of all terms.

    A document's words are grouped where it lies, without a shuffle; only rows of an id that
    stands in several rows, which are one document, go the way of ``postings``.  That
    one takes up a filter of terms, so a search that stores no index uses it.
    """
    small_batches(docs.sparkSession)
    repeated = docs.groupBy(F.col(id_col).alias("_id")).count().where("count > 1 or _id is null").select("_id")
    n = repeated.count()
    held = F.broadcast(repeated) if n <= REPEATED else repeated
    alone = docs.join(held, F.col(id_col).eqNullSafe(F.col("_id")), "left_anti") if n else docs
    weights = [WEIGHTS[c] for c in fields.values()]
    worded = alone.select(F.col(id_col).alias("doc_id"), *(tokens(F.col(name)).alias(f"t{k}") for k, name in enumerate(fields)))

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [batch.column(k + 1).value_lengths().to_numpy() for k in range(len(weights))]
            longest = np.max(counts, axis=0)
            for k, weight in enumerate(weights):
                words = batch.column(k + 1).flatten().dictionary_encode()
                n = counts[k]
                row = np.repeat(np.arange(len(n)), n)
                place = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
                key = row * max(1, len(words.dictionary)) + words.indices.to_numpy()
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.diff(key[order], prepend=-1))
                ends = np.append(first[1:], len(order))
                for lo in range(0, len(first), ROWS):
                    at, to = first[lo : lo + ROWS], ends[lo : lo + ROWS]
                    own, rows = order[at], row[order[at]]
                    places = pa.ListArray.from_arrays(pa.array(np.append(at, to[-1:]) - at[0], pa.int32()), pa.array(place[order[at[0] : to[-1]]]))
                    columns = [batch.column(0).take(pa.array(rows)), words.dictionary.take(words.indices.take(pa.array(own))), pa.array(np.full(len(at), weight)), places, pa.array(n[rows].astype(np.int32)), pa.array(longest[rows].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(c.split()[0] for c in POSTING.split(", "))])

    found = worded.mapInArrow(grouped, f"doc_id {dict(worded.dtypes)['doc_id']}, {POSTING}")
    if n:
        rest = postings(docs.join(held, F.col(id_col).eqNullSafe(F.col("_id")), "left_semi"), id_col, fields).drop("tf")
        rest = rest.withColumn("longest", F.max("doc_len").over(Window.partitionBy("doc_id")))
        found = found.union(rest.select(*found.columns))
    if language:
        found = found.join(stemmed(found, language), "term").groupBy("doc_id", F.col("stem").alias("term"), "weight").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"), F.max("doc_len").alias("doc_len"), F.max("longest").alias("longest"))
    return found.select("doc_id", "term", "weight", F.size("positions").cast("long").alias("tf"), "positions", "doc_len", "longest")


def stemmed(words: DataFrame, language: str) -> DataFrame:
    """``term, stem`` of the distinct terms that aren't stop words: each is stemmed once, not each time it stands in a text."""
    known(language)

    @F.pandas_udf("string")
    def stems(terms: pd.Series) -> pd.Series:
        return terms.map(stem)

    return words.select("term").distinct().where(~F.col("term").isin(*sorted(STOP))).withColumn("stem", stems("term"))


def known(language: str) -> None:
    if language != "english":
        raise ValueError(f"no stems for {language!r}")


def save(index: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store postings in folders by a hash of the term, sorted by term in each file."""
    marked = index.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)))
    marked.repartition("bucket").sortWithinPartitions("bucket", "term", "doc_id").write.mode("errorifexists").partitionBy("bucket").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Stored postings; ``of_terms`` then reads only the folders of a query's terms."""
    return spark.read.parquet(path)


def of_terms(index: DataFrame, terms: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The postings of some terms."""
    out = index.where(F.col("term").isin(terms)) if terms else index.limit(0)
    if "bucket" in index.columns and terms:
        folders = index.sparkSession.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(buckets))).distinct().collect()  # one for each term
        out = out.where(F.col("bucket").isin([r[0] for r in folders]))
    return out


#: Terms with their places from the phrase's first word on.
Phrase = tuple[tuple[int, str], ...]


@dataclass
class Query:
    """``required``: all groups must match, a group if one of its phrases does; ``excluded``: no phrase may."""

    required: list[list[Phrase]] = field(default_factory=list)
    excluded: list[Phrase] = field(default_factory=list)

    @property
    def terms(self) -> list[str]:
        """The terms that count for the rank."""
        return sorted({t for g in self.required for p in g for _, t in p})

    @property
    def all_terms(self) -> list[str]:
        return sorted({*self.terms, *(t for p in self.excluded for _, t in p)})


def parse_query(text: str, language: str | None = None) -> Query:
    """Quotes make phrases, ``or`` joins neighbours to alternatives, ``-`` excludes; words are required otherwise.

    In a language stop words say nothing: a phrase of such words only is left out.
    """
    if language:
        known(language)
    out, joined = Query(), False
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text):
        if not minus and word.lower() == "or":
            joined = bool(out.required)
            continue
        found = re.findall(r"[^\W_]+", (quoted or word).lower())
        phrase = tuple((k, stem(w) if language else w) for k, w in enumerate(found) if not (language and w in STOP))
        if not phrase:
            continue
        if minus:
            out.excluded.append(phrase)
        elif joined:
            out.required[-1].append(phrase)
        else:
            out.required.append([phrase])
        joined = False
    return out


def _holds(phrase: Phrase) -> Column:
    """Whether the postings ``p`` of a document have the phrase's terms at its distances, in one field."""
    if len(phrase) == 1:
        return F.exists("p", lambda x: x["term"] == phrase[0][1])
    fields = [F.size(reduce(F.array_intersect, [_starts(k, t, weight) for k, t in phrase])) > 0 for weight in sorted(set(WEIGHTS.values()))]
    return reduce(Column.__or__, fields)


def _starts(place: int, term: str, weight: float) -> Column:
    """Where a phrase would have to begin for a term's positions in one field."""
    mine = F.filter("p", lambda x: (x["term"] == term) & (x["weight"] == weight))
    return F.transform(F.flatten(F.transform(mine, lambda x: x["positions"])), lambda at: at - place)


def evaluate(index: DataFrame, query: Query) -> DataFrame:
    """``doc_id, by_words, rank`` of the documents that have some of the query's terms (all documents if it only excludes):
    whether its words select them, and their rank; from one pass over its terms' postings.
    """
    met = of_terms(index, query.all_terms).groupBy("doc_id").agg(F.collect_list(F.struct("term", "weight", "tf", "positions", "doc_len")).alias("p"))
    if not query.required:
        every = index.select("doc_id").distinct() if query.excluded else index.select("doc_id").limit(0)
        met = every.join(met, "doc_id", "left").withColumn("p", F.coalesce("p", F.filter(F.array(F.struct(F.lit("").alias("term"), F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("tf"), F.array().cast("array<int>").alias("positions"), F.lit(0).alias("doc_len"))), lambda x: F.lit(False))))
    wanted = F.lit(True)
    for group in query.required:
        wanted = wanted & reduce(Column.__or__, map(_holds, group))
    for phrase in query.excluded:
        wanted = wanted & ~_holds(phrase)
    ranked = F.filter("p", lambda x: x["term"].isin(query.terms)) if query.terms else F.filter("p", lambda x: F.lit(False))
    score = F.aggregate(ranked, F.lit(0.0), lambda s, x: s + x["weight"] * (1 + F.log(x["tf"])) / (1 + F.log(x["doc_len"])))
    return met.select("doc_id", wanted.alias("by_words"), score.alias("rank"))


def matches(index: DataFrame, query: Query) -> DataFrame:
    """``doc_id`` of the documents that the query's words select."""
    return evaluate(index, query).where("by_words").select("doc_id")


def rank(index: DataFrame, query: Query) -> DataFrame:
    """``doc_id, rank`` of every document that has some of the query's terms."""
    score = F.col("weight") * (1 + F.log("tf")) / (1 + F.log("doc_len"))
    return of_terms(index, query.terms).groupBy("doc_id").agg(F.sum(score).alias("rank"))


def near_vector(docs: DataFrame, query_vector: list[float], vector_col: str = "embedding") -> DataFrame:
    """``docs`` with ``distance`` to the query vector; null where a document has no vector."""
    q = F.array(*(F.lit(round(float(x), 6)) for x in query_vector))
    return docs.withColumn("distance", vectors.cosine_distance(F.col(vector_col), q))


def hybrid(docs: DataFrame, index: DataFrame, text: str, query_vector: list[float] | None = None, id_col: str = "doc_id", substring_cols: tuple[str, ...] = (), radius: float = RADIUS, language: str | None = None) -> DataFrame:
    """Documents that match by words, by substring of a column or by vector, with ``rank, distance, score``.

    Documents with a vector score half their rank and half their nearness; those without score their rank.
    Without a query vector (also when the provider failed) the words alone decide.
    ``%`` and ``_`` of the text are wildcards in the substring match.
    """
    found = evaluate(index, parse_query(text, language)).select(F.col("doc_id").alias("_id"), "by_words", F.col("rank").alias("_rank"))
    if query_vector is None and not substring_cols:  # the words alone decide: only their documents are read
        found = found.where("by_words").drop("by_words")
        out = docs.join(found, docs[id_col] == found["_id"]).withColumn("rank", F.col("_rank")).drop("_id", "_rank")
        return out.withColumn("distance", F.lit(None).cast("double")).withColumn("score", F.col("rank"))
    # rows that match by something else have a rank too, as far as they have the query's terms
    out = docs.join(found, docs[id_col] == found["_id"], "left")
    wanted = F.coalesce("by_words", F.lit(False))
    for c in substring_cols:
        wanted = wanted | F.coalesce(F.ilike(F.col(c), F.lit(f"%{text}%")), F.lit(False))
    words = F.coalesce("_rank", F.lit(0.0))
    if query_vector is None:
        return out.where(wanted).withColumn("rank", words).drop("by_words", "_id", "_rank").withColumn("distance", F.lit(None).cast("double")).withColumn("score", F.col("rank"))
    out = near_vector(out, query_vector)
    wanted = wanted | F.coalesce(F.col("distance") < radius, F.lit(False))
    out = out.where(wanted).withColumn("rank", words).drop("by_words", "_id", "_rank")
    score = F.when(F.col("distance").isNotNull(), 0.5 * F.col("rank") + 0.5 * (1 - F.col("distance"))).otherwise(F.col("rank"))
    return out.withColumn("score", score)


def page(found: DataFrame, number: int = 1, order: tuple[str, ...] = ("score",), id_col: str = "doc_id", size: int = PAGE) -> DataFrame:
    """One page, best first, larger ids first among equals."""
    keys = [F.col(c).desc() for c in (*order, id_col)]
    return found.orderBy(*keys).offset((max(1, number) - 1) * size).limit(size)


def page_count(total: int, size: int = PAGE) -> int:
    return max(1, math.ceil(total / size))


def scope_topic(cards: DataFrame, topics: DataFrame, wanted: str | None, topic_col: str = "topic_id") -> DataFrame:
    """Absent: the current topic; ``all`` or an unknown slug: every card; else that topic."""
    if wanted == "all":
        return cards
    row = topics.where(F.col("is_current") if wanted is None else F.col("slug") == wanted).select("id").first()
    return cards if row is None else cards.where(F.col(topic_col) == row["id"])


def tagged(cards: DataFrame, links: DataFrame, closure: DataFrame, tags: DataFrame, slug: str | None, id_col: str = "card_id") -> DataFrame:
    """Cards that carry the tag or one below it; an unknown or absent slug filters nothing."""
    if slug is None:
        return cards
    root = tags.where(F.col("slug") == slug).select("tag_id").first()
    if root is None:
        return cards
    below = closure.where(F.col("ancestor") == root["tag_id"]).select(F.col("descendant").alias("tag_id"))
    ids = links.join(below, "tag_id", "left_semi").select(F.col("card_id").alias("_c"))
    return cards.join(ids, cards[id_col] == F.col("_c"), "left_semi")


def of_school(cards: DataFrame, uploads: DataFrame, school: str, fk: str = "wiki_upload_id") -> DataFrame:
    """Cards disclosed by a school, whatever the case of its name."""
    ids = uploads.where(F.lower("school") == school.lower()).select(F.col("upload_id").alias("_u"))
    return cards.join(ids, cards[fk] == F.col("_u"), "left_semi")


def matching_any(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows of which some column holds the text, whatever the case; null columns never match."""
    return rows.where(reduce(Column.__or__, [F.coalesce(F.ilike(F.col(c), F.lit(f"%{text}%")), F.lit(False)) for c in columns]))
