"""Near-duplicates against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from marginalia.llm import minhash as M
from marginalia.llm.shingles import Shingler
from tests.llm.fixtures import SCHEMA, collected, documents, nothing, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, s):
    sets = {i: shingle_set(t, s.width) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= s.percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(base, rng, share):
    return " ".join(w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in base.split())


def near_rows():
    rng = random.Random(5)
    texts = []
    for g in range(6):
        base = prose(100 + g, rng.choice([12, 40, 150, 400]))
        texts += [base] * rng.randrange(1, 4) + [edited(base, rng, rng.choice([0.01, 0.03, 0.05, 0.1])) for _ in range(40)]
    texts += [prose(900 + k, 30) for k in range(40)] + [None, "", " ", "one", "one", "ONE", "a b", "a b c", "a b c d"]
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("s", [M.CONTRACT, M.Setting()])
def test_components_equal_brute_force(spark, s):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in collected(M.near_duplicates(df, s))}
    assert got == brute(rows, s)
    assert {r["doc_id"] for r in collected(M.near_duplicates(df, s)) if r["kept"]} == {i for i, (_, c) in got.items() if i == c}


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 7)
    monkeypatch.setattr(M, "BROADCAST_IDS", 0)
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in collected(M.near_duplicates(df, M.CONTRACT))}
    assert got == brute(rows, M.CONTRACT)


def test_awkward_rows(spark):
    out = collected(M.near_duplicates(documents(spark, extra=True), M.CONTRACT))
    assert len(out) == documents(spark).count()
    by = {r["doc_id"]: r for r in out}
    assert by[2]["component_id"] == 0 and not by[2]["kept"]  # case only
    assert by[8]["component_id"] == 7
    assert all(by[i]["component_id"] == i and by[i]["n_shingles"] == 0 and by[i]["kept"] for i in (4, 5, 6))
    assert sum(r["doc_id"] == 0 and r["kept"] for r in out) == 2  # a repeated row has its twin's result
    nameless = next(r for r in out if r["doc_id"] is None)
    assert nameless["component_id"] is None and nameless["kept"] is False


def test_no_rows(spark):
    assert M.near_duplicates(nothing(spark), M.CONTRACT).count() == 0


def test_one_id_with_two_texts(spark):
    df = spark.createDataFrame([(1, prose(1, 50)), (1, prose(2, 50)), (2, prose(2, 50))], "doc_id long, text string")
    assert sorted(r["component_id"] for r in collected(M.near_duplicates(df, M.CONTRACT))) == [1, 1, 1]


def test_set_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    s, words = M.CONTRACT, Shingler(3)
    for n in (5, 100, 3000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: n * 9 // 10], rng.integers(0, 2**63, n // 10 + 1).astype(np.uint64)])
        x, y = M.sign(np.unique(a), s)[2], M.sign(np.unique(b), s)[2]
        m = min(len(x), len(y))
        apart = np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, m)) ^ np.bitwise_xor.reduce(y.reshape(-1, m))).sum()
        assert apart <= len(np.setxor1d(a, b))
    assert len(words.shingles("a b c d")) == 2 and len(words.shingles("a b")) == 1 and len(words.shingles(" ")) == 0


def test_words_part_at_ascii_space_only():
    w = Shingler(3)
    assert len(w.words("a b\x0bc\x0cd\re")) == 5 and len(w.words("a\u00a0b")) == 1 and len(w.words("A")) == 1
    assert w.words("ABC")[0] == w.words("abc")[0] and w.words("É")[0] != w.words("é")[0]
    assert SCHEMA
