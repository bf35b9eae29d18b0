"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import phrases
from tests.llm.fixtures import SCHEMA, documents, nothing

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    """(lang, rank, phrase, a, l, r, n, score), by counting every run."""
    total, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        some = {p: n for p, n in counts.items() if n >= least}
        longer = Counter()
        for p, n in some.items():
            w = p.split(" ")
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    longer[" ".join(w[i : i + k])] = max(longer[" ".join(w[i : i + k])], n)
        found = []
        for p, a in some.items():
            w = p.split(" ")
            if len(w) < 2 or longer[p] and 100 * longer[p] >= 80 * a:
                continue
            cut = lambda k: (counts[" ".join(w[:k])], counts[" ".join(w[k:])])
            score, k = min((2000000 * a // sum(cut(k)), k) for k in range(1, len(w)))
            found.append((score, a, p, *cut(k)))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, n, p, a, left, right, total[lang], s) for n, (s, a, p, left, right) in enumerate(found[:top], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(k, t, g, "s", None) for k, (g, t) in enumerate(rows)], SCHEMA).repartition(4)


def made(seed, n=300):
    """Few words, so that phrases repeat; odd white space, pieces, capitals and letters beyond ASCII."""
    rng = random.Random(seed)
    vocabulary = ["The", "of", "çà", "É", "new", "york", "city", "hall", "a b", "-", "x"]
    rows = []
    for _ in range(n):
        w = []
        for _ in range(rng.randrange(30)):
            w += rng.choice([["New", "York", "City", "Hall"], ["of", "the"], [rng.choice(vocabulary)], [rng.choice(vocabulary) + rng.choice(".,;:!?\n\r\x0b")]])
        rows.append((rng.choice(["en", "fr", None, ""]), rng.choice([" ", "  ", "\t"]).join(w)))
    return [*rows, ("en", None), (None, ""), ("de", "one word")]


@pytest.mark.parametrize("least,top", [(30, 2000), (3, 7)])
def test_against_plain(spark, least, top):
    rows = made(least)
    got = sorted(map(tuple, phrases.collocations(frame(spark, rows), least, top).collect()))
    assert got == plain(rows, least, top) and len(got) > 10


def test_a_sketch_that_is_far_too_small(spark, monkeypatch):
    """Overestimates cost time only: with 64 cells nearly every run survives the first pass."""
    rows = made(5)
    monkeypatch.setattr(phrases, "cells_for", lambda words, longest: 64)
    assert sorted(map(tuple, phrases.collocations(frame(spark, rows), 5).collect())) == plain(rows, 5, 2000)


def test_hot_language_and_phrase(spark):
    rows = [("en", "new york city hall")] * 700 + [("en", "new york")] * 200 + [(f"l{k}", "a b c. a b") for k in range(40)]
    assert sorted(map(tuple, phrases.collocations(frame(spark, rows)).collect())) == plain(rows, 30, 2000)


def test_a_sketch_never_underestimates(spark):
    rows = [("en", "a " * 100_000 + "b c d e f g " * 29)]
    bits = phrases.sketch(frame(spark, rows).select("lang", "text"), 1 << 16, 30, 4)
    from marginalia.llm.words import Words

    words = Words([rows[0][1].encode()], phrases._BETWEEN)
    piece = np.zeros(len(words), np.int64)
    for k in range(1, 5):
        ok, found = phrases._runs("en", words.marks(), piece, k)
        _, at, n = np.unique(found[ok], return_index=True, return_counts=True)
        assert phrases._has(bits, found[ok][at])[n >= 30].all() and not phrases._has(bits, found[ok][at])[n < 30].all()


def test_counters_of_tasks_add_up(spark):
    """29 in one task and one in another reach the limit together."""
    rows = spark.createDataFrame([("en", "p q " * 29)], "lang string, text string").union(spark.createDataFrame([("en", "p q")], "lang string, text string"))
    assert {(r.size, r.phrase, r.f) for r in phrases.phrase_counts(rows).collect()} >= {(1, "p", 30), (1, "q", 30), (2, "p q", 30)}


def test_wide_limits(spark):
    rows = [("en", "a b " * 400)]
    assert {(r.size, r.f) for r in phrases.phrase_counts(frame(spark, rows), least=300).collect()} == {(0, 800), (1, 400), (2, 400), (2, 399), (3, 399), (4, 399), (4, 398)}
    with pytest.raises(ValueError):
        phrases.phrase_counts(frame(spark, rows), least=20_000)


def test_cells_follow_the_input_up_to_a_bound():
    assert phrases.cells_for(0) == phrases.FEWEST_CELLS and phrases.cells_for(10**12) == phrases.MOST_CELLS
    assert phrases.cells_for(10**8) == 2 * phrases.cells_for(5 * 10**7) < phrases.MOST_CELLS


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_rows(spark, extra):
    docs = documents(spark, extra)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert sorted(map(tuple, phrases.collocations(docs, 2, 50).collect())) == plain(rows, 2, 50)


def test_nothing(spark):
    assert phrases.collocations(nothing(spark)).collect() == []


def test_products_beyond_64_bits(spark):
    big = spark.createDataFrame([(10**14, 10**14, 1)], "a long, l long, r long")
    out = big.select(F.expr("(cast(a as decimal(38,0)) * 2000000) div (cast(l as decimal(38,0)) + cast(r as decimal(38,0)))").alias("s")).first()
    assert out.s == 2000000 * 10**14 // (10**14 + 1)
