"""Benchmark decontamination by pigeonhole edit matching.

A test item counts as leaked if a stretch of a document lies within the item's error
budget, ``rate`` times its length in edits (insertions, deletions, substitutions).
Of budget + 1 pieces of the item at least one then stands in the document unchanged.
One Aho-Corasick automaton finds all pieces of all items in one pass; each hit fixes
where the item would lie, and Myers' bit-parallel distance decides there.

Texts are compared as words: case-folded runs of letters and digits, joined by single
spaces, so case, punctuation, table bars and line breaks don't hide a copy.  A space
before and after an item belongs to its pattern, so an item that begins or ends inside
a word costs an edit, and one without a budget never matches inside words.

An item of fewer than ``least_words`` words (four by default) says too little to be
told from common speech; it leaks only where it is all that a document says.

Items go to the executors in blocks of ``block_chars`` characters, each block against
all documents.  The driver holds one block at a time, as a broadcast variable; with
more than one block each block's leaks are written before the next is read.  So memory
doesn't follow the benchmark's size.

Edge cases: null or wordless documents and items match nothing; items of the same text
are each reported; a doc_id or item_id that stands in several rows is reported once,
with its least distance; of places of equal distance the first counts; rows without
doc_id can't be named and aren't reported (the pipeline judges them by a hash of their
text); very long texts are searched whole, in time that follows their length; other
columns, also of the names used here, play no part; empty tables give an empty result.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import Stage, small_batches, table

WORD = re.compile(r"[^\W_]+")
RATE, LEAST_WORDS = 0.08, 4


def normal(text: str | None) -> str:
    return " ".join(WORD.findall(text.casefold())) if text else ""


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length, each with its offset."""
    n = budget + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def letters(item: str) -> dict[str, int]:
    """For each character the places where the item has it, as bits."""
    out: dict[str, int] = {}
    for k, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << k
    return out


def nearest(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The least edit distance of a pattern of ``m`` characters to a stretch of ``text``, and where that stretch ends."""
    mask, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best, end = mask, 0, m, m, 0
    for k, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (mask & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & mask
        pv = ((mh << 1) & mask) | (mask & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, k
    return best, end


class Block:
    """A block of items: one automaton over all pieces, and of each item id, length, budget, bits forwards and backwards."""

    def __init__(self, items: tuple[tuple[int, str], ...], rate: float, least_words: int) -> None:
        self.known, self.short = [], {}
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            if text.count(" ") + 1 < least_words:
                self.short.setdefault(text, []).append(item_id)
                continue
            budget, padded = int(len(text) * rate), f" {text} "
            for at, piece in pieces(padded, budget):
                places.setdefault(piece, []).append((len(self.known), at))
            self.known.append((item_id, len(padded), budget, letters(padded), letters(padded[::-1])))
        self.auto = ahocorasick.Automaton() if places else None
        for piece, found in places.items():
            self.auto.add_word(piece, (len(piece), found))
        if places:
            self.auto.make_automaton()

    def leaks(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """``item_id, distance, length of the item, start, end`` in the normal text: of each item the place of least distance."""
        if not text:
            return []
        out = [(i, 0, len(text), 0, len(text)) for i in self.short.get(text, ())]
        if self.auto is not None:
            # places are counted without the space before the text, and an item's own spaces don't belong to it
            out += [(i, d, m - 2, a, min(max(a, b - 2), len(text))) for i, d, m, a, b in leaks(f" {text} ", self.auto, self.known)]
        return out


@functools.lru_cache(maxsize=2)
def prepared(items: tuple[tuple[int, str], ...], rate: float, least_words: int) -> Block:
    """One block for each worker process and set of items."""
    return Block(items, rate, least_words)


def leaks(text: str, auto, known) -> list[tuple[int, int, int, int, int]]:
    """``item_id, distance, length of the pattern, start, end`` in the text: of each pattern the place of least distance."""
    guesses: dict[int, list[int]] = {}
    for end, (n, found) in auto.iter(text):
        for k, at in found:
            guesses.setdefault(k, []).append(end + 1 - n - at)
    out = []
    for k, starts in guesses.items():
        item_id, m, budget, peq, back = known[k]
        best = (budget + 1, 0, 0)
        starts.sort()
        lo, hi = starts[0], starts[0]
        for s in [*starts[1:], None]:  # neighbouring guesses share a window
            if s is not None and s - hi <= budget:
                hi = s
                continue
            a = max(0, lo - budget)
            d, end = nearest(peq, m, text[a : hi + m + budget])
            if d < best[0]:
                end += a
                tail = text[max(0, end - m - budget) : end][::-1]
                start = end - next_start(back, m, tail, d)
                best = (d, start, end)
            if s is not None:
                lo = hi = s
        if best[0] <= budget:
            out.append((item_id, best[0], m, *best[1:]))
    return out


def next_start(back: dict[str, int], m: int, tail: str, distance: int) -> int:
    """How long the stretch is that ends where ``tail`` (reversed) begins and has that distance."""
    return next((n for n in range(max(1, m - distance), min(len(tail), m + distance) + 1) if whole(back, m, tail[:n]) == distance), min(len(tail), m))


def whole(peq: dict[str, int], m: int, text: str) -> int:
    """The edit distance of the pattern to all of ``text``."""
    mask, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score = mask, 0, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (mask & ~(xh | pv))
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = (ph << 1 | 1) & mask
        pv = ((mh << 1) & mask) | (mask & ~(xv | ph))
        mv = ph & xv
    return score


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least_words: int = LEAST_WORDS, block_chars: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, distance, item_chars, first_char, last_char``: every leaked pair, places in the normal text."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), benchmark[item_text].alias("text")).where("item_id is not null and text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + chars // block_chars
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).where("text is not null and doc_id is not null")
    out = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int64()), ("item_chars", pa.int64()), ("first_char", pa.int64()), ("last_char", pa.int64())])
    schema = "doc_id long, item_id long, distance long, item_chars long, first_char long, last_char long"
    stage = Stage(spark, "leaks") if blocks > 1 else None
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).distinct().collect()  # of bounded size
        sent = spark.sparkContext.broadcast(tuple(sorted((r["item_id"], n) for r in block if (n := normal(r["text"])))))

        def run(batches, sent=sent):
            ready = prepared(sent.value, rate, least_words)
            for b in batches:
                rows = [(i, *x) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in ready.leaks(normal(t))]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(out)], schema=out)

        found = texts.mapInArrow(run, schema)
        if stage:
            stage.put(found, f"leaks/block={k}")
            sent.destroy()
    found = stage.get("leaks") if stage else found
    least = F.min(F.struct("distance", "first_char", "last_char", "item_chars")).alias("x")
    return found.groupBy("doc_id", "item_id").agg(least).select("doc_id", "item_id", "x.distance", "x.item_chars", "x.first_char", "x.last_char")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
