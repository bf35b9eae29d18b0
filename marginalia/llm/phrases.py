"""Phrase collocations: phrases of two to four words that stand together oftener than their parts.

1. Count-min sketches.  Each task counts the hashes of all runs of one to four words in two
   rows of small counters that stop at the limit; tasks' sketches are merged slice by slice,
   and a cell becomes one bit: whether its sum reaches the limit.  Counts are only ever
   overestimated, so each run that reaches the limit has both its bits set.
2. Exact counts.  A second pass counts, by its words, each run whose bits are set, as those
   of its parts must be; what falls short of the limit goes.  Nothing frequent is lost.
3. The lowest of the scores of a phrase's cuts counts; phrases that stand almost always
   inside a longer one are dropped; the best of each language are ranked.

The sketch has one cell for twelve to twenty-four runs, up to ``MOST_CELLS``, so that the bits (an
eighth of the cells, twice) have a fixed bound and may go to every executor.  Beyond that
bound it lets more through and the second pass counts more; the result is the same.

Edge cases: null and empty texts have no words; null languages are ``und``; words are cut at
blanks and tabs only, so other white space belongs to a word; rows without doc_id, repeated
rows and repeated doc_ids all count; equal scores go by count, then by the phrase's bytes;
very long texts are read whole, one at a time; an empty table gives an empty result; other
columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.common import Stage, small_batches, table
from marginalia.llm.words import Words, gathered, windows

#: Occurrences that a phrase needs, phrases reported for a language, words of the longest.
LEAST, TOP, LONGEST = 30, 2000, 4
#: Bounds of a sketch row's cells; cells of one slice; bytes of text that one task's sketch stands for, at least.
FEWEST_CELLS, MOST_CELLS, SLICE, TASK_BYTES = 1 << 16, 1 << 26, 1 << 16, 2 << 30
#: Parts in which the phrases of a language are ranked first.
PARTS = 64

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BETWEEN = _BREAK.copy()
_BETWEEN[[0x20, 0x09]] = True


def cells_for(words: int, longest: int = LONGEST) -> int:
    """Cells of a row: a power of two, between a twelfth and a twenty-fourth of the runs."""
    return min(MOST_CELLS, max(FEWEST_CELLS, 1 << (words * longest // 24).bit_length()))


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words, np.ndarray]]:
    """Language, words and the number of each word's piece, for parts of the batches (lang, text)."""
    for langs, texts in gathered(batches, 1):
        for lang in sorted(set(langs)):
            words = Words([t.lower() for one, t in zip(langs, texts) if one == lang], _BETWEEN)
            yield lang, words, np.cumsum(_BREAK[words.data], dtype=np.int64)[words.start]


def _runs(lang: str, marks: np.ndarray, piece: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which places begin a run of ``k`` words within a piece, and the hash of each place's run."""
    if len(marks) < k:
        return np.zeros(0, bool), np.zeros(0, np.uint64)
    seed = np.uint64(int.from_bytes(hashlib.blake2b(f"{k} {lang}".encode(), digest_size=8).digest(), "little"))
    return piece[: len(piece) - k + 1] == piece[k - 1 :], windows(marks ^ seed, k)


def _cells(found: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return found.astype(np.uint32) & np.uint32(width - 1), (found >> np.uint64(32)).astype(np.uint32) & np.uint32(width - 1)


def _add(row: np.ndarray, cells: np.ndarray, least: int) -> None:
    """Count each cell's hits, up to ``least``."""
    cells = np.sort(cells)
    last = np.flatnonzero(np.append(cells[1:] != cells[:-1], True))
    at, n = cells[last], np.diff(last, prepend=-1)
    row[at] = np.minimum(row[at] + n, least)


def sketch(rows: DataFrame, width: int, least: int, longest: int) -> np.ndarray:
    """Two rows of bits: whether a cell's runs (of lang, text) sum up to ``least``."""
    kind = np.uint8 if least <= 255 else np.uint16
    if least > 1 << 14:
        raise ValueError("the sketch's counters stop at 16,384")
    out = pa.schema([("slice", pa.int32()), ("cells", pa.binary())])
    size = min(SLICE, width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, width), kind)
        for lang, words, piece in _by_language(batches):
            marks = words.marks()
            for k in range(1, longest + 1):
                ok, found = _runs(lang, marks, piece, k)
                if ok.any():
                    for row, cells in zip(seen, _cells(found[ok], width)):
                        _add(row, cells, least)
        for k, part in enumerate(seen.reshape(-1, size)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()])], schema=out)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for b in batches:
            for k, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != key:
                    if key is not None:
                        yield bits(key, total)
                    key, total = k, np.zeros(size, np.int64)
                total += np.frombuffer(cells, kind)
        if key is not None:
            yield bits(key, total)

    def bits(key: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()])], schema=out)

    parts = rows.mapInArrow(count, "slice int, cells binary")
    merged = parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, "slice int, cells binary")
    both = np.zeros((2 * width // size, size // 8), np.uint8)
    for k, packed in merged.collect():  # an eighth of a byte for each cell
        both[k] = np.frombuffer(packed, np.uint8)
    return both.reshape(2, -1)


def _has(bits: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Whether both cells of each hash have their bit."""
    out = np.ones(len(found), bool)
    for row, cells in zip(bits, _cells(found, 8 * bits.shape[1])):
        out &= (row[cells >> np.uint32(3)] >> (cells & np.uint32(7)).astype(np.uint8)) & 1 == 1
    return out


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, size, phrase, f`` of all runs of up to ``longest`` words that occur ``least`` times in a language; size 0 has the number of all its words."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).cast("long")).first()[0] or 0
    # a task's sketch is as large for little text as for much: few tasks, but as many as cores
    tasks = max(2 * spark.sparkContext.defaultParallelism, size // TASK_BYTES)
    bits = spark.sparkContext.broadcast(sketch(rows.coalesce(int(tasks)), cells_for(size // 6, longest), least, longest))
    out = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, piece in _by_language(batches):
            marks = words.marks()
            made: list[tuple[int, list[bytes], np.ndarray]] = [(0, [b""], np.array([len(words)]))]
            alive, ids, base = np.ones(len(words) + 1, bool), np.zeros(len(words), np.int64), np.zeros(0, np.int64)
            for k in range(1, longest + 1):
                ok, found = _runs(lang, marks, piece, k)
                at = np.flatnonzero(ok & alive[:-1][: len(ok)] & alive[1:][: len(ok)])  # both runs of one word less, too
                at = at[_has(bits.value, found[at])]
                if not len(at):
                    break
                # a run is the number of the run before its last word, and that word's
                key = marks[at] if k == 1 else ids[at].astype(np.uint64) << np.uint64(32) | base[at + k - 1].astype(np.uint64)
                _, first, inverse, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                ids[at] = inverse
                if k == 1:
                    base = ids.copy()
                alive = np.zeros(len(words) + 1, bool)
                alive[at] = True
                made.append((k, [b" ".join(map(words.word, range(p, p + k))) for p in at[first].tolist()], n))
            for k, texts, n in made:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(texts)), pa.array([k] * len(texts), pa.int32()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], schema=out)

    counted = rows.mapInArrow(count, "lang string, size int, phrase string, f long").groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
    return counted.where(f"size = 0 or f >= {int(least)}")


def _whole(column: str):
    return F.col(column).cast("decimal(38,0)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language; see the module's text.

    Of the cut with the lowest score ``a`` is the phrase's count, ``l`` and ``r`` its parts';
    ``score`` is floor(2,000,000 a / (l + r)); ``n`` is the language's number of words.
    """
    counts = Stage(docs.sparkSession, "phrases").put(phrase_counts(docs, least, longest, text_col, lang_col), "counts")
    phrases = counts.where("size >= 2")
    word = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.array_join(F.slice(word, F.lit(1), F.col("k")), " ")).withColumn("right", F.array_join(F.slice(word, F.col("k") + 1, F.col("size") - F.col("k")), " "))
    parts = counts.where("size >= 1")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.withColumn("d", _whole("l") + _whole("r")).withColumn("m", _whole("a") * 2_000_000).withColumn("score", F.expr("m div d"))
    best = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.*")
    # each phrase inside a longer one, with the longer one's count
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda at: F.array_join(F.slice(word, at, n), " "))))
    inner = counts.where("size >= 3").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * _whole("longer") < 80 * _whole("a")))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    few = kept.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
