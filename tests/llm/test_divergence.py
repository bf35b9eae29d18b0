"""Source divergence against plain sums over all kept terms."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from marginalia.llm import common, divergence
from tests.llm.fixtures import SCHEMA, documents, nothing, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=30, top=50):
    """(lang, source, part, item, value, rank), term by term."""
    count, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        count[lang, source].update(w)
        df[lang].update(set(w))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        share = lambda n, all_: 1 + 10**9 * (n + 5) // (all_ + 5 * len(kept))
        p = {s: {t: share(count[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(count[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])
            for part, found in (("pair", pairs), ("term", terms[:top])):
                out += [(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(found, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(k, t, g, s, None) for k, (t, g, s) in enumerate(rows)], SCHEMA).repartition(4)


def made(seed, n=400):
    rng = random.Random(seed)
    rows = [(prose(seed * n + k, rng.randrange(60)).replace("a1", "É'Ü-a"), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "ç", "zz", None])) for k in range(n)]
    return [*rows, (None, "en", "silent"), ("", "xx", "one"), ("solo", "xx", "two"), ("solo", "yy", "alone")]


@pytest.mark.parametrize("least", [30, 2])
def test_against_plain(spark, least):
    rows = made(least)
    got = sorted(map(tuple, divergence.divergence(frame(spark, rows), least).collect()))
    assert got == plain(rows, least) and {r[2] for r in got} == {"pair", "term"}


def test_vectors_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_CELLS", 40)
    rows = made(4, 150)
    assert sorted(map(tuple, divergence.divergence(frame(spark, rows), 2).collect())) == plain(rows, 2)


def test_equal_vectors_are_evaluated_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "scratch_root", lambda spark: f"file://{tmp_path}")
    rows = [("p q r s", "en", "a")] * 40 + [("p q r t", "en", "b")] * 40
    assert sorted(map(tuple, divergence.divergence(frame(spark, rows)).collect())) == plain(rows)
    (at,) = (tmp_path / "marginalia").glob("divergence-*/classes")
    assert sorted((r.rep, r.m) for r in spark.read.parquet(f"file://{at}").collect()) == [("p", 3), ("s", 1), ("t", 1)]


def test_only_the_first_ranks_of_terms(spark):
    rows = [(" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)), "en", "hot")] * 35 + [("other words", "en", "b")] * 35
    got = sorted(map(tuple, divergence.divergence(frame(spark, rows)).collect()))
    assert got == plain(rows) and max(r[5] for r in got if r[2] == "term") == 50


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_rows(spark, extra):
    docs = documents(spark, extra)
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert sorted(map(tuple, divergence.divergence(docs, 2).collect())) == plain(rows, 2)


def test_nothing(spark):
    assert divergence.divergence(nothing(spark)).collect() == []


def test_shares_are_exact():
    rng = random.Random(1)
    cases = [(rng.randrange(10**15), rng.randrange(1, 9 * 10**15)) for _ in range(2000)]
    cases = [(c, max(c + 5, d)) for c, d in cases]
    got = divergence.share(np.array([c for c, _ in cases]), np.array([d for _, d in cases]))
    assert got.tolist() == [1 + 10**9 * (c + 5) // d for c, d in cases]
