"""Edit matching against a plain dynamic programme over every document and item."""

import random
import time

import pytest

from marginalia.llm import decontaminate as C
from tests.llm.fixtures import collected, documents, nothing, prose


def best_infix(pattern, text):
    """The least edit distance of the pattern to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edit(text, n, rng):
    out = list(text)
    for _ in range(n):
        k = rng.randrange(len(out))
        what = rng.randrange(3)
        if what == 0:
            out[k] = rng.choice("xyz")
        elif what == 1:
            out.insert(k, rng.choice("xyz"))
        else:
            del out[k]
    return "".join(out)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(9)
    items = [(k, prose(50 + k, rng.choice([3, 8, 20]))) for k in range(12)]
    docs = []
    for d in range(60):
        text = prose(500 + d, rng.randrange(0, 30))
        if d % 2:
            item = rng.choice(items)[1]
            n = rng.randrange(0, int(len(item) * 0.16) + 1)
            text = text + "\n" + edit(item, n, rng) + ". " + prose(600 + d, 5)
        docs.append((d, text.upper() if d % 5 == 0 else text.replace(" ", "!! | ") if d % 7 == 0 else text))
    return docs, items


def test_equals_brute_force(spark, cases):
    docs, items = cases
    want = {}
    for d, text in docs:
        for k, item in items:
            a, b = C.normal(text), C.normal(item)
            n = best_infix(f" {b} ", f" {a} ") if b.count(" ") + 1 >= C.LEAST_WORDS else 0 if a == b else 99
            if n <= int(len(b) * C.RATE):
                want[d, k] = n
    df, bm = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = collected(C.find_leaks(df, bm))
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in got} == want and len(want) > 10
    texts = dict(docs)
    for r in got:  # the place has that distance, but for the spaces around it
        part = C.normal(texts[r["doc_id"]])[r["first_char"] : r["last_char"]]
        item = C.normal(dict(items)[r["item_id"]])
        assert C.whole(C.letters(item), len(item), part) <= r["distance"] + 2
        if r["distance"] == 0:
            assert part == item and r["item_chars"] == len(item)


def test_every_number_of_edits_within_the_budget_is_found():
    """The pigeonhole holds: recall is 1 from no edit to the whole budget."""
    rng = random.Random(31)
    items = tuple((k, prose(50 + k, rng.choice([5, 12, 40]))) for k in range(8))
    block = C.Block(items, C.RATE, C.LEAST_WORDS)
    for k, item in items:
        budget = int(len(item) * C.RATE)
        for n in range(budget + 1):
            for _ in range(12):
                text = C.normal(f"{prose(rng.randrange(10**6), 6)} {edit(item, n, rng)} {prose(rng.randrange(10**6), 6)}")
                assert min((x[1] for x in block.leaks(text) if x[0] == k), default=99) <= n


def test_short_items_and_word_borders(spark):
    bm = spark.createDataFrame([(1, "A"), (2, "the"), (3, "other cats bathe"), (4, "red cars go far")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "other cats bathe"), (2, "so other cats bathe"), (3, "The!"), (4, "bored cars go farther"), (5, "a red cars, go FAR"), (6, "the a the")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in collected(C.find_leaks(docs, bm))) == [(1, 3), (3, 2), (5, 4)]


def test_long_texts_take_time_in_proportion():
    block = C.Block(((1, prose(5, 30)), (2, "aaaa " * 30)), C.RATE, C.LEAST_WORDS)
    for text in (prose(8, 60_000), "aaaa " * 100_000, prose(5, 29) * 2000):
        began = time.process_time()
        block.leaks(C.normal(text))
        assert time.process_time() - began < 30


def test_blocks_of_items_give_the_same(spark, cases):
    docs, items = cases
    df, bm = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda x: sorted((r["doc_id"], r["item_id"], r["distance"]) for r in collected(x))
    assert key(C.find_leaks(df, bm, block_chars=300)) == key(C.find_leaks(df, bm))


def test_myers_distances():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab c") for _ in range(rng.randrange(1, 80))) for _ in "12")
        assert C.nearest(C.letters(a), len(a), b)[0] == best_infix(a, b)


def test_awkward_rows(spark):
    bm = spark.createDataFrame([(1, prose(3, 90), "x"), (2, None, "x"), (3, "", "x"), (4, "!!!", "x"), (5, prose(3, 90), "x"), (None, prose(3, 90), "x")], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]) for r in collected(C.find_leaks(documents(spark, extra=True), bm))}
    assert got == {(3, 1), (3, 5)}
    assert C.find_leaks(nothing(spark), bm).count() == 0
    assert C.find_leaks(documents(spark), bm.limit(0)).count() == 0
