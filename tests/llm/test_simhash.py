"""Fingerprints against a plain version, and block tables against all pairs."""

import hashlib
import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from marginalia.llm import simhash as H
from tests.llm.fixtures import collected, documents, nothing, prose


def with_ids(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_edited_texts_follow_the_next_document(spark, monkeypatch):
    monkeypatch.setattr(H, "GROUP_IDS", 5)
    rng = random.Random(1)
    rows = [(i * i - 40, prose(i, rng.randrange(0, 60))) for i in range(40)] + [(5000, None), (5001, ""), (5002, "é🙂xyz12345")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    ordered = with_ids({i: t or "" for i, t in rows}.items())
    got = {r["doc_id"]: r for r in collected(H.compare_edited(df.dropDuplicates(["doc_id"])))}
    assert len(got) == len(ordered)
    for (i, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1]):
        q = len(t) // 4
        assert got[i]["n_chars"] == len(t)
        edited = t[: len(t) - q] + n[:q]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if edited == t:
            assert got[i]["near_edited"] == 1.0 and got[i]["fingerprint"] == got[i]["edited_fingerprint"]


def test_bits_are_the_majority_of_term_hashes(spark, monkeypatch):
    words = "a b c a b d a b".split()
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words * 9000))], "doc_id long, text string")
    assert len(" ".join(words * 9000)) > H.SHORT_BYTES
    hashes = {(x, y): spark.sql(f"SELECT xxhash64('{x}', '{y}') AS hi, xxhash64(xxhash64('{x}', '{y}'), 7) AS lo").first() for x, y in itertools.product("abcd", repeat=2)}

    def want(text, name):
        pairs = Counter(zip(text, text[1:]))
        return sum(1 << k for k in range(64) if 2 * sum(n * ((hashes[p][name] >> k) & 1) for p, n in pairs.items()) > sum(pairs.values()))

    for _ in range(2):
        for r in collected(H.fingerprints(df, "text", ["doc_id"])):
            assert [r[c] % (1 << 64) for c in ("hi", "lo")] == [want(words * (1 if r["doc_id"] == 1 else 9000), c) for c in ("hi", "lo")]
        monkeypatch.setattr(H, "SHORT_BYTES", 0)  # counted two bits to a sum, with the same result


def test_block_tables_find_all_pairs(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(128) for _ in range(20)]
    prints = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for k in rng.sample(range(128), rng.randrange(1, 7)):
                x ^= 1 << k
            prints.add(x)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(p >> 64), signed(p & (1 << 64) - 1)) for p in prints], "hi long, lo long")
    for radius, spare in ((3, 1), (3, 2), (5, 2)):
        want = {(f"{min(a, b):032x}", f"{max(a, b):032x}") for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= radius}
        got = {tuple(sorted((r["a"], r["b"]))) for r in collected(H.near_pairs(df, radius, spare))}
        assert got == want and want


def test_neighbour_counts(spark):
    df = spark.createDataFrame([(i, "same words here again and again" if i % 2 else prose(i, 40)) for i in range(100)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_near"] for r in collected(H.with_neighbours(H.compare_edited(df)))}
    assert got[50] == 0 and got[0] == 0 and got[1] is None
    odd = spark.createDataFrame([(i, "same words here again and again") for i in range(100)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_near"] for r in collected(H.with_neighbours(H.compare_edited(odd)))}[50] == 99


def test_edited_copies_are_neighbours(spark):
    words = prose(3, 150).split()
    texts = {0: words} | {k: words[: 9 * k] + ["edited"] + words[9 * k + 1 :] for k in range(1, 9)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()] + [(50 + i, prose(90 + i, 150)) for i in range(20)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_near"] for r in collected(H.with_neighbours(H.compare_edited(df)))}
    assert got[0] == 8 and got[50] == 0


def test_neighbours_equal_all_pairs(spark):
    rng = random.Random(8)
    prints = [rng.getrandbits(128) for _ in range(30)]
    prints += [p ^ sum(1 << k for k in rng.sample(range(128), rng.randrange(1, 26))) for p in prints for _ in range(12)]
    prints += [p ^ sum(1 << (k + s) % 128 for k in range(20)) for p in prints[:9] for s in (0, 50, 60, 120)]
    weight = {p: rng.randrange(1, 9) for p in prints}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(p >> 64), signed(p & (1 << 64) - 1), m) for p, m in weight.items()], "hi long, lo long, m long")
    for radius, parts in ((20, 7), (3, 5), (9, 4)):
        want = {p: sum(m for q, m in weight.items() if (p ^ q).bit_count() <= radius) for p in prints[::3]}
        asks = spark.createDataFrame([(signed(p >> 64), signed(p & (1 << 64) - 1)) for p in want], "hi long, lo long")
        got = {(r["hi"] % (1 << 64)) << 64 | r["lo"] % (1 << 64): r["n"] for r in collected(H.neighbours(asks, df, radius, parts))}
        assert got == want


def test_counts_of_the_query_equal_all_pairs(spark, sf_dir):
    rows = collected(H.op6_simhash(spark, sf_dir))
    prints = [int(r["fingerprint"], 16) for r in rows]
    assert len(rows) == 200 and any(r["n_near"] for r in rows)
    for r, p in zip(rows, prints):
        want = sum((p ^ q).bit_count() <= H.RADIUS for q in prints) - 1 if r["doc_id"] % 50 == 0 else None
        assert r["n_near"] == want


def test_many_rows_of_one_id_or_of_none_are_cut_into_parts(spark, monkeypatch):
    """Groups beyond HOT_ROWS are cut by id and mark; the rows stay in one order, each with its next."""
    monkeypatch.setattr(H, "HOT_ROWS", 10)
    rng = random.Random(7)
    rows = [(None, prose(i, 9)) for i in range(120)] + [(77, prose(500 + i, 9)) for i in range(90)] + [(70 + i % 15, prose(900 + i, 9)) for i in range(60)] + [(10**7 + i, prose(2000 + i, 9)) for i in range(8)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.xxhash64("text")).repartition(3)
    assert H.groups(df).groupBy("grp", "sub").count().count() > 200
    led = collected(H.with_next(df))
    order = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["mark"]), r["text"]) for r in led)
    assert len(led) == len(rows)
    after = {a[0]: b for a, b in zip(order, order[1:] + order[:1])}
    for r in led:
        k, text = after[r["doc_id"] is not None, r["doc_id"] or 0, r["mark"]]
        assert (r["next_id"] is not None, r["next_id"] or 0, r["next_mark"], r["next_text"]) == (*k, text)


def test_awkward_rows(spark):
    df = documents(spark, extra=True)
    out = collected(H.compare_edited(df))
    assert len(out) == df.count()
    assert len({r["fingerprint"] for r in out if r["doc_id"] in (7, 8)}) == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    one = spark.createDataFrame([(1, "only one here")], "doc_id long, text string")
    assert collected(H.compare_edited(one))[0]["near_next"] == 1.0
    assert H.compare_edited(nothing(spark)).count() == 0
    assert H.compare_edited(df.where(F.col("doc_id").isNull())).count() == 1
