"""Substring deduplication against all windows of all documents."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import common, repeats
from marginalia.llm.registry import query
from marginalia.llm.words import CHUNK, Words, gathered, windows
from tests.llm.fixtures import SCHEMA, documents, nothing, prose


def plain(rows, width):
    """(doc_id, n_words, n_removed, text) of each row, by the words themselves."""
    worded = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in worded:
        for k in range(len(w) - width + 1):
            if i is not None:
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in worded:
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_rows(spark, extra):
    docs = documents(spark, extra)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(repeats.without_repeats(docs)) == plain(rows, 13)


def passages(seed, n=40):
    """Documents that share passages at every distance from the period's places, some with one word changed."""
    rng = random.Random(seed)
    shared = [prose(seed + k, 60).split() for k in range(4)]
    rows = []
    for i in range(n):
        w = prose(1000 * seed + i, rng.randrange(0, 40)).split()
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            lo = rng.randrange(40)
            part = s[lo : lo + rng.randrange(5, 30)]
            if rng.random() < 0.3:
                part = [*part[:6], "changed", *part[7:]]
            at = rng.randrange(len(w) + 1)
            w[at:at] = part
        rows.append((rng.randrange(n * 50), rng.choice([" ", "\n", " \t "]).join(w)))
    return rows


@pytest.mark.parametrize("width", [1, 2, 13, 14, 45])
def test_passages(spark, width):
    rows = passages(width)
    assert got(repeats.without_repeats(frame(spark, rows), width)) == plain(rows, width)


def test_joins_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BROADCAST_IDS", -1)
    rows = passages(7)
    assert got(repeats.without_repeats(frame(spark, rows))) == plain(rows, 13)


def test_hot_passage_and_repeated_ids(spark):
    hot = prose(1, 60)
    rows = [(i, f"{prose(50 + i, 10)} {hot} {prose(900 + i, 20)}") for i in range(300)] + [(5, hot), (5, hot), (None, hot), (None, None), (-3, hot), (2**62, hot)]
    assert got(repeats.without_repeats(frame(spark, rows))) == plain(rows, 13)


def test_a_hot_passage_asks_once_a_task(spark):
    hot = prose(1, 60)
    rows = frame(spark, [(i, hot) for i in range(500)]).coalesce(1).select("doc_id", "text")
    asked = repeats._map(rows, 13, repeats._every_anchor, False, False).where("mark is null")
    assert asked.count() == len({k for k in range(54) if k % 7 in repeats.COVERS[7]})


@pytest.mark.parametrize("period", list(repeats.COVERS))
def test_covers(period):
    c = repeats.COVERS[period]
    for i in range(period):
        for j in range(period):
            assert any((i + s) % period in c and (j + s) % period in c for s in range(period))


def test_nothing(spark):
    assert repeats.without_repeats(nothing(spark)).collect() == []


def test_runs_say_which_words_went(spark):
    rows = passages(13)
    for r in repeats.without_repeats(frame(spark, rows)).collect():
        assert sum(x.end - x.start for x in r.removed) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:]))


def test_words_and_chunks():
    space = repeats._SPACE
    w = Words([b"", b" a bb", b"a", b"", b"bb a\n"], space)
    assert [w.word(k) for k in range(len(w))] == [b"a", b"bb", b"a", b"bb", b"a"] and w.owner.tolist() == [1, 1, 2, 4, 4]
    m = w.marks()
    assert m[0] == m[2] == m[4] and m[1] == m[3] != m[0] and len(windows(m, 6)) == 0 and windows(m, 2)[1] == windows(m, 2)[3] != windows(m, 2)[0]
    import pyarrow as pa

    texts = ["x" * 10, None, "y" * (CHUNK + 5), "z", "é"]
    batches = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array([t])], ["id", "t"]) for k, t in enumerate(texts)]
    parts = list(gathered(batches, 1))
    assert [p[0] for p in parts] == [[0, 1], [2], [3, 4]] and parts[2][1] == [b"z", "é".encode()] and parts[0][1][1] == b""
    assert np.concatenate([Words(p[1], space).first for p in parts]).tolist() == [0, 1, 1, 0, 1, 0, 1, 2]


def test_query_against_plain(spark, sf_dir):
    import hashlib

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = [(i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in plain([(r.doc_id, r.text) for r in docs.collect()], 13)]
    assert sorted((tuple(r) for r in query("op13_repeats")(spark, sf_dir).collect()), key=str) == sorted(want, key=str)
    assert sum(x[2] for x in want) > 0


def test_tables_go_to_the_scratch_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "scratch_root", lambda spark: f"file://{tmp_path}")
    repeats.without_repeats(documents(spark)).select(F.sum("n_removed")).collect()
    assert list((tmp_path / "marginalia").glob("repeats-*/windows/*.parquet"))
