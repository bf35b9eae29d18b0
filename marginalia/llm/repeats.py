"""Substring deduplication: passages that an earlier document holds already are taken out.

A window is a run of ``width`` consecutive words of one document.  Each word that is
covered by a window whose words also start in a document with a smaller doc_id goes.

Not every window is hashed.  ``COVERS`` has difference covers: sets of residues modulo a
period such that for any two places one shift below the period brings both onto residues
of the set.  Two equal windows thus hold an equal shorter run, their anchor, that begins
at a cover place in both, whatever their places are; with a width of 13 anchors are runs of
seven words at three places of seven.  Only the windows around anchors that two documents
share are looked at (the extension): a window that holds no shared anchor repeats nowhere.
Those windows are compared by 95 bits over all documents, and the first document of each
keeps its words.

Both comparisons are one shuffle of small rows.  Documents that a task holds together are
compared there first: a window that stands in many of them asks once, for the first of
them, and the others know their answer; so a passage that a third of all documents share
is a row a task, not a row a document.

Edge cases: null and empty texts have no words; texts of fewer words than a window lose
nothing; rows without doc_id lose nothing and take nothing from others; rows of one doc_id
take nothing from each other, and a repeated row loses the same as the first; very long
texts are read whole, one at a time; an empty table gives an empty result; other columns,
whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.common import Stage, small_batches, table
from marginalia.llm.minhash import BROADCAST_IDS
from marginalia.llm.shingles import _SPACE, mix
from marginalia.llm.words import Words, gathered, windows

WIDTH = 13
# Perfect difference sets by their period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Bits of an anchor's number; a chance hit among 10**13 of them costs a look at a few windows, no more.
ANCHOR_BITS = 48


def period_of(width: int) -> int:
    """The longest period that leaves anchors of half a window at least."""
    return max(p for p in COVERS if 2 * p <= width + 1)


def _anchors(words: Words, marks: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors, and their numbers."""
    period = period_of(width)
    size = width - period + 1
    found = windows(marks, size)
    place = np.arange(len(found))
    inner = place - words.first[words.owner[: len(found)]]
    ok = np.isin(inner % period, COVERS[period]) & (words.owner[: len(found)] == words.owner[size - 1 :])
    ok &= (words.first[1:] - words.first[:-1] >= width)[words.owner[: len(found)]]  # shorter texts have no window
    at = place[ok]
    return at, found[at] >> np.uint64(64 - ANCHOR_BITS)


def _windows(words: Words, marks: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the windows, 63 bits of each and 32 more."""
    found, more = windows(marks, width), windows(mix(marks ^ np.uint64(0x5BF0A8B1)), width)
    at = np.flatnonzero(words.owner[: len(found)] == words.owner[width - 1 :]) if len(found) else np.zeros(0, np.int64)
    return at, found[at] >> np.uint64(1), (more[at] >> np.uint64(32)).astype(np.uint32)


_ASKED = pa.schema([("key", pa.int64()), ("more", pa.int32()), ("doc_id", pa.int64()), ("mark", pa.int64())])


def _asks(ids: np.ndarray, keys: np.ndarray, more: np.ndarray, first_only: bool) -> pa.RecordBatch:
    """Rows that ask and rows that know, of the places of one chunk.

    Each (key, more) asks once, for its smallest id.  With ``first_only`` the other ids
    know that a smaller one has it; else all ids know it, if there are two.
    """
    order = np.lexsort((ids, more, keys))
    i, k, m = ids[order], keys[order], more[order]
    fresh = np.ones(len(i), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
    once = fresh.copy()
    once[1:] |= i[1:] != i[:-1]
    i, k, m, fresh = i[once], k[once], m[once], fresh[once]
    known = ~fresh
    if not first_only:
        known[:-1] |= ~fresh[1:]
    # rows that know pass under a negative key of their own document
    own = -1 - (mix(i[known].view(np.uint64)) >> np.uint64(64 - ANCHOR_BITS)).astype(np.int64)
    ask = k[fresh].astype(np.int64)
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([ask, own])), pa.array(np.concatenate([m[fresh].astype(np.uint32).view(np.int32), np.zeros(len(own), np.int32)])),
        pa.array(np.concatenate([i[fresh], i[known]])), pa.array(np.concatenate([ask, k[known].astype(np.int64)]), mask=np.concatenate([np.ones(len(ask), bool), np.zeros(len(own), bool)])),
    ], schema=_ASKED)


def _map(rows: DataFrame, width: int, places: Callable, first_only: bool, marked: bool) -> DataFrame:
    """Ask for the places that ``places`` finds in each document; with ``marked`` a document's list of marks is its third column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, *lists in gathered(batches, 1):
            words = Words(texts, _SPACE)
            at, keys, more = places(words, words.marks(), width, lists[0] if marked else None)
            yield _asks(np.array(ids, np.int64)[words.owner[at]], keys, more, first_only)

    return rows.mapInArrow(run, "key long, more int, doc_id long, mark long")


def _every_anchor(words: Words, marks: np.ndarray, width: int, _) -> tuple:
    at, keys = _anchors(words, marks, width)
    return at, keys, np.zeros(len(at), np.uint32)


def _near_anchors(words: Words, marks: np.ndarray, width: int, lists: list[list[int]]) -> tuple:
    """The windows that hold an anchor of their document's list."""
    at, keys = _anchors(words, marks, width)
    shared = np.zeros(len(words) + 1, np.int64)
    shared[at[_listed(words, at, keys, lists)] + 1] = 1
    shared = np.cumsum(shared)
    at, keys, more = _windows(words, marks, width)
    near = shared[at + period_of(width)] > shared[at]
    return at[near], keys[near], more[near]


def _listed(words: Words, at: np.ndarray, keys: np.ndarray, lists: list) -> np.ndarray:
    """Whether each place's key stands in the list of its document."""
    out = np.zeros(len(at), bool)
    edge = np.searchsorted(at, words.first)
    for lo, hi, marks in zip(edge[:-1], edge[1:], lists):
        if marks and hi > lo:
            out[lo:hi] = np.isin(keys[lo:hi].astype(np.int64), np.array(marks, np.int64))
    return out


def _answers(asked: DataFrame, first_only: bool) -> DataFrame:
    """``doc_id, marks``: the marks of each document that another, or a smaller one, has too."""
    by = Window.partitionBy("key", "more").orderBy("doc_id")
    if first_only:
        met = F.first("doc_id").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) < F.col("doc_id")
    else:
        met = F.lag("key").over(by).isNotNull() | F.lead("key").over(by).isNotNull()
    found = asked.withColumn("met", met).where(F.col("mark").isNotNull() | F.col("met"))
    return found.groupBy("doc_id").agg(F.collect_list(F.coalesce("mark", "key")).alias("marks"))


def _holding(rows: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows with their document's list, and the other rows (none: they are among the first, their list null).

    While the ids are few only the texts that have a list are shuffled; beyond that all are.
    """
    if lists.count() > BROADCAST_IDS:
        return rows.join(lists, "doc_id", "left"), None
    ids = F.broadcast(lists.select("doc_id"))
    return rows.join(ids, "doc_id", "left_semi").join(lists, "doc_id"), rows.join(ids, "doc_id", "left_anti")


def without_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, removed, text`` of each row.

    ``removed`` has the runs of words that went, as ``start, end`` (words from 0, end
    exclusive); ``text`` the words left, joined by one space.
    """
    small_batches(docs.sparkSession)
    stage = Stage(docs.sparkSession, "repeats")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    named = rows.where("doc_id is not null")
    anchors = stage.put(_answers(_map(named, width, _every_anchor, False, False), False), "anchors")
    near = _holding(named, anchors)[0].where("marks is not null")
    repeated = stage.put(_answers(_map(near, width, _near_anchors, True, True), True), "windows")
    some, others = _holding(rows, repeated)
    if others is not None:
        some = some.union(others.withColumn("marks", F.lit(None).cast("array<long>")))
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("text", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, lists in gathered(batches, 1):
            words = Words(texts, _SPACE)
            covered = np.zeros(len(words) + 1, np.int64)
            if any(lists):
                at, keys, _ = _windows(words, words.marks(), width)
                hit = at[_listed(words, at, keys, lists)]
                covered[hit] += 1  # a place begins one window at most
                covered[hit + width] -= 1
            gone = np.cumsum(covered)[:-1] > 0
            result = [_cut(words, gone, words.first[k], words.first[k + 1]) for k in range(len(ids))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([ids, *zip(*result)], out)], schema=out)

    return some.mapInArrow(cut, "doc_id long, n_words long, n_removed long, removed array<struct<start: long, end: long>>, text string")


def _cut(words: Words, gone: np.ndarray, lo: int, hi: int) -> tuple[int, int, list[dict], str]:
    """Number of words, number and runs of those gone, and the text of the others."""
    mine = np.zeros(hi - lo + 2, np.int8)
    mine[1:-1] = gone[lo:hi]
    step = np.diff(mine)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    kept = np.flatnonzero(~gone[lo:hi]) + lo
    text = b" ".join(words.data[a:b].tobytes() for a, b in zip(words.start[kept], words.end[kept])).decode("utf-8")
    return hi - lo, int((end - start).sum()), [{"start": int(a), "end": int(b)} for a, b in zip(start, end)], text


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
