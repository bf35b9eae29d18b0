"""Source divergence: how far the word use of each source stands from the other sources of its language.

Of each language the terms that at least ``LEAST`` of its documents hold are kept.  A group
is a language's source; each kept term has a smoothed share in it, in billionths.  Two
sources diverge by the sum of the differences of all shares; a term stands out in a source
by what its share exceeds the language's.

Most terms are rare and many have the same few counts.  So terms are grouped by their
sparse vector of counts (``source, count`` where the count isn't 0): shares and all
differences are worked out once for each distinct vector, and a difference counts as
often as there are terms with that vector.  Vectors are dealt into blocks of bounded size,
and a block adds up its pairs of sources before anything is sent on.  The original terms
then take their vector's figures and are ranked.

All arithmetic is on whole numbers; the share's division is done in steps of a thousand, so
that no product passes 64 bits.

Edge cases: null texts, languages and sources count as empty strings; a group without terms
has all counts 0; a language without kept terms has differences of 0; documents are rows:
rows without doc_id, repeated rows and repeated doc_ids all count; equal values go by the
item's bytes; very long texts are read whole, one at a time; an empty table gives an empty
result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.common import Stage, small_batches, table
from marginalia.llm.words import Words, gathered

#: Documents that a kept term needs; terms reported for a source; what is added to each count.
LEAST, TOP, ADDED = 30, 50, 5
#: Bytes of texts counted together: the more, the fewer rows go on.
CHUNK = 3 << 20
#: Cells (vectors times sources) of one block.
BLOCK_CELLS = 1 << 20

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, df``: occurrences of each term in a group, and its documents; a null term for each group itself."""
    small_batches(docs.sparkSession)
    rows = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    out = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, sources, texts in gathered(batches, 2, CHUNK):
            words = Words([t.lower() for t in texts], _BETWEEN)
            groups = sorted(set(zip(langs, sources)))
            number = {g: k for k, g in enumerate(groups)}
            group = np.array([number[g] for g in zip(langs, sources)], np.int64)
            _, first, term = np.unique(words.marks(), return_index=True, return_inverse=True)
            many = len(first) + 1
            pairs, n = np.unique(group[words.owner] * many + term, return_counts=True)
            held = np.unique(words.owner * many + term)
            df = np.bincount(np.searchsorted(pairs, group[held // many] * many + held % many), minlength=len(pairs))
            own, none = np.arange(len(groups)), np.zeros(len(groups), np.int64)  # a row without a term for each group
            of = np.concatenate([pairs // many, own])
            at = pa.array(np.concatenate([pairs % many, none]), mask=np.concatenate([np.zeros(len(pairs), bool), np.ones(len(groups), bool)]))
            names = pa.array([words.word(k) for k in first.tolist()], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(pa.array([g[c] for g in groups], pa.string()).take(pa.array(of)) for c in (0, 1)), names.take(at), pa.array(np.concatenate([n, none])), pa.array(np.concatenate([df, none]).astype(np.int64))], schema=out)

    return rows.mapInArrow(count, "lang string, source string, term string, n long, df long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(count: np.ndarray, below: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (count + 5) / below), by long division in base 1,000."""
    whole, rest = np.divmod(count + ADDED, below)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + more
    return whole + 1


def _evaluate(key: tuple, vectors: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """``lang, source, part, item, value`` of one block of a language's vectors: the sums of its pairs of
    sources, and for each vector (named by its first term) the sources in which it stands out.
    """
    groups = groups.sort_values("source", ignore_index=True)
    names = groups.source.to_numpy()
    at = {s: k for k, s in enumerate(names)}
    kept = int(groups.kept.iloc[0])
    pair = np.zeros((len(names), len(names)), np.int64)
    rows: list[tuple] = []
    if len(vectors):
        count = np.zeros((len(vectors), len(names)), np.int64)
        for k, vec in enumerate(vectors.vec):
            for cell in vec:
                count[k, at[cell["source"]]] = cell["n"]
        p = share(count, groups.total.to_numpy() + ADDED * kept)
        times = vectors.m.to_numpy()[:, None]
        for k in range(len(names) - 1):
            pair[k, k + 1 :] = (np.abs(p[:, k + 1 :] - p[:, k : k + 1]) * times).sum(axis=0)
        beyond = p - share(count.sum(axis=1), np.int64(groups.lang_total.iloc[0] + ADDED * kept))[:, None]
        rows = [(names[j], "term", vectors.rep.iloc[i], int(beyond[i, j])) for i, j in zip(*np.nonzero((count > 0) & (beyond > 0)))]
    pair += pair.T
    rows += [(names[i], "pair", names[j], int(pair[i, j])) for i in range(len(names)) for j in range(len(names)) if i != j]
    return pd.DataFrame(rows, columns=["source", "part", "item", "value"]).assign(lang=key[0])


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: see the module's text."""
    stage = Stage(docs.sparkSession, "divergence")
    counts = stage.put(term_counts(docs, text_col, lang_col, source_col), "counts")
    vec = F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vec")  # one entry a source
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("df").alias("df"), vec).where(F.col("df") >= least)
    terms = stage.put(terms.select("lang", "term", "vec"), "terms")
    classes = stage.put(terms.groupBy("lang", "vec").agg(F.min("term").alias("rep"), F.count("*").alias("m")), "classes")
    cells = classes.select("lang", "m", F.explode("vec").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum(F.col("m") * F.col("x.n")).alias("total"))
    langs = classes.groupBy("lang").agg(F.sum("m").alias("kept"), F.count("*").alias("vectors"))
    every = counts.where("term is null").select("lang", "source").join(cells, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "kept", "vectors"])
    of_lang = every.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count("*").alias("sources"), F.first("vectors").alias("v"))
    of_lang = of_lang.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") * F.col("sources") / BLOCK_CELLS)).cast("int")).drop("v")
    groups = stage.put(every.drop("vectors").join(of_lang, "lang"), "groups")
    blocks = groups.groupBy("lang").agg(F.first("blocks").alias("blocks"))
    dealt = classes.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    told = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found = dealt.groupBy("lang", "block").cogroup(told.groupBy("lang", "block")).applyInPandas(_evaluate, "lang string, source string, part string, item string, value long")
    found = stage.put(found, "found")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    stands = found.where("part = 'term'").select("lang", "source", "part", F.col("item").alias("rep"), "value")
    # ranked terms take the figures of their vector, which its first term names
    named = terms.join(classes.select("lang", "vec", "rep"), ["lang", "vec"]).select("lang", "rep", F.col("term").alias("item"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    out = named.join(stands, ["lang", "rep"]).select("lang", "source", "part", "item", "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return out.unionByName(pairs.withColumn("rank", F.row_number().over(order))).select("lang", "source", "part", "item", "value", "rank")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))
