"""License labels against a plain search."""

import random
import re

from marginalia.llm import licenses as L
from tests.llm.fixtures import collected, documents, nothing, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def base(text):
    w, places, labels = words(text), [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_equals_plain_search(spark):
    rng = random.Random(4)
    bits = ["Under", "the", "MIT", "License", "apache", "version", "2", "2.0", "cc", "BY-NC", "by", "nc", "é", "İ", "K", "\n", "...", "🙂", "word"]
    rows = [(k, " ".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for k in range(400)]
    rows += [(1000, "cc by nc cc by nc by cc-by-nc"), (1001, "under the mit license " * 50), (1002, None), (1003, ""), (1003, ""), (None, "CC BY-NC"), (1004, prose(1, 3000) + " Under the MIT License")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in collected(L.digest(L.votes(df)))), key=str)
    assert got == sorted(((i is None, i or 0, *base(t)) for i, t in rows), key=str)


def test_method_finds_altered_notices(spark):
    notice = next(p for p, v in L.NOTICES.items() if v == "mit")
    w = notice.split()
    altered = " ".join([*w[:10], "REALLY", *w[10:30], *w[31:]]).upper()
    rows = [(1, prose(1, 200) + " " + altered + " " + prose(2, 50)), (2, " ".join(w[:12])), (3, "GNU General Public License, version 3."), (4, "gnu general public license version 4"), (5, "cc by-sa")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["base_labels"]) for r in collected(L.digest(L.votes(df)))}
    assert got == {1: ("mit", ""), 2: ("", ""), 3: ("gpl-3", ""), 4: ("", ""), 5: ("cc-by-sa", "")}
    place = collected(L.spans(df).where("doc_id = 1"))[0]
    assert place["first_word"] == 200 and abs(place["n_words"] - len(w)) <= 2


def test_awkward_rows(spark):
    df = documents(spark, extra=True)
    assert L.digest(L.votes(df)).count() == df.count()
    assert L.digest(L.votes(nothing(spark))).count() == 0


def test_merging_works_on_every_long_notice(spark):
    """A word put in and one left out move the rest of a notice to neighbouring diagonals, whose votes are merged."""
    long = [(p.split(), label) for p, label in L.NOTICES.items() if len(p.split()) > 15]
    assert len(long) >= 15
    rows = [(k, " ".join([*prose(k, 30).split(), *w[:6], "really", *w[6:]])) for k, (w, _) in enumerate(long)] + [(100 + k, " ".join(w[-(len(w) // 3) :])) for k, (w, _) in enumerate(long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in collected(L.digest(L.votes(df)))}
    for k, (_, label) in enumerate(long):
        assert label in got[k]["labels"].split(","), label
        assert label not in got[100 + k]["labels"].split(",") and got[k]["score"] >= L.SHARE
