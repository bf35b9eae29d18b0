"""Language and toxicity models: held-out accuracy, calibration, counterfactual penalty, folds."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from marginalia.llm import langid, toxicity
from marginalia.llm.common import bucket_of
from tests.llm.fixtures import collected, documents, nothing

WORDS = {"en": "the of and to in is that for with was".split(), "de": "der die und das nicht mit sich auf für den".split(), "fr": "le la les des une est pour que dans qui".split()}


def speech(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang]) if rng.random() < 0.7 else "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def test_folds(spark):
    df = spark.range(200).withColumnRenamed("id", "doc_id")
    got = {r["doc_id"]: (r["a"], r["b"]) for r in collected(df.select("doc_id", bucket_of("doc_id", 4).alias("a"), bucket_of("doc_id", 5).alias("b")))}
    assert got == {i: (zlib.crc32(str(i).encode()) % 4, zlib.crc32(str(i).encode()) % 5) for i in range(200)}


def test_language_of_held_out_texts(spark):
    rng = random.Random(1)
    rows = [(i, speech(lang, rng.randrange(5, 60), rng), lang) for i in range(300) for lang in [rng.choice(list(WORDS))]]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "123 ... 456", "fr"), (1003, speech("en", 40, rng), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id < 200 or doc_id > 999"))
    got = {r["doc_id"]: r for r in collected(langid.predict(df, model))}
    assert len(got) == len(rows) and model.langs == ["de", "en", "fr"]
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in rows if 200 <= i < 300) >= 97
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[1003]["lang_pred"] == "en"
    assert 0.02 <= model.temperature <= 20 and (model.weights == 0).mean() > 0.3  # sparse


def test_document_frequencies_cover_all(spark):
    df = spark.createDataFrame([("ab",), ("ab",), ("zz",), ("",)], "text string").repartition(3)
    df_, n = langid.document_frequencies(df)
    assert n == 4
    assert np.array_equal(df_, sum((langid.counts(t) > 0).astype(int) for t in ("ab", "ab", "zz", "")))


def plain_counts(text):
    """The hashed n-grams of a text one by one, in whole numbers."""
    out, points, m32 = Counter(), [ord(c) for c in text.lower()], 2**32 - 1
    for i in range(len(points)):
        h = 0
        for n in range(min(langid.ORDERS, len(points) - i)):
            h = (h ^ (points[i + n] + n + 1)) * int(langid.MIX[n]) & m32
            h ^= h >> 15
            out[(h * int(langid.MIX[0]) & m32) >> (32 - langid.BITS)] += 1
    return out


def test_counts_equal_a_plain_loop():
    for text in ("", "a", "Ab", "naïve café 🙂 Ω", "the of and to " * 20):
        got = langid.counts(text)
        assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == plain_counts(text)


def plain_ftrl(rows, classes, alpha=0.5, beta=1.0, l1=0.02, l2=0.5, epochs=4, seed=7):
    """Follow-the-regularised-leader, a coordinate at a time."""
    z, n, bias = defaultdict(float), defaultdict(float), langid.SIZE

    def weight(i, c):
        pull = 0.0 if i == bias else l1
        if abs(z[i, c]) <= pull:
            return 0.0
        return -(z[i, c] - math.copysign(pull, z[i, c])) / ((beta + math.sqrt(n[i, c])) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, at, x = rows[k]
            given = [*zip(at.tolist(), x.tolist()), (bias, 1.0)]
            w = {(i, c): weight(i, c) for i, _ in given for c in range(classes)}
            e = [math.exp(sum(v * w[i, c] for i, v in given)) for c in range(classes)]
            for c in range(classes):
                for i, v in given:
                    g = v * (e[c] / sum(e) - (c == y))
                    step = (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / alpha
                    z[i, c] += g - step * w[i, c]
                    n[i, c] += g * g
    return weight


def test_ftrl_equals_a_plain_version():
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(60):
        at = np.unique(rng.integers(0, 25, rng.integers(1, 7)))
        rows.append((int(rng.integers(0, 3)), at, rng.random(len(at))))
    weights, bias = langid.ftrl(rows, 3)
    plain = plain_ftrl(rows, 3)
    for c in range(3):
        assert bias[c] == pytest.approx(plain(langid.SIZE, c))
        assert [weights[i, c] for i in range(25)] == pytest.approx([plain(i, c) for i in range(25)])
    assert 0 < np.count_nonzero(weights) < weights.size


def test_predictions_equal_a_plain_softmax(spark):
    rng = random.Random(5)
    rows = [(i, speech(lang, rng.randrange(1, 50), rng), lang) for i in range(120) for lang in [rng.choice(list(WORDS))]] + [(500, "x" * 300_000 + " the of and", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    got = {r["doc_id"]: r for r in collected(langid.predict(df, model))}
    for i, text, _ in rows:
        x = {k: math.log(1 + n) * model.idf[k] for k, n in plain_counts(text).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        logit = [(sum(v / norm * model.weights[k, c] for k, v in x.items()) + model.bias[c]) / model.temperature for c in range(3)]
        p = [math.exp(v - max(logit)) for v in logit]
        best = max(range(3), key=lambda c: p[c])
        assert got[i]["lang_pred"] == model.langs[best] and got[i]["score"] == pytest.approx(p[best] / sum(p), abs=1e-4)


def test_rare_languages_are_not_learned(spark):
    rows = [(i, f"some words {i}", "en" if i < 30 else f"junk{i}" if i < 60 else "de") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.train(df).langs == ["de", "en"] and langid.train(df, most_langs=1).langs == ["en"] and langid.train(df, least_docs=100).langs == []


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 400)
    logits = rng.normal(0, 8, (400, 3))
    logits[np.arange(400), y] += 5
    loss = lambda t: np.mean([-np.log(langid.softmax(z / t)[k]) for z, k in zip(logits, y)])
    t = langid.temperature(logits, y)
    assert t > 1 and loss(t) < loss(1.0)


def test_no_language_to_learn(spark):
    got = collected(langid.predict(documents(spark, extra=True), langid.train(nothing(spark))))
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)} and len(got) == documents(spark).count()


def labelled(n, rng):
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 60))]
        if toxic:
            w += rng.sample(["vile", "rotten", "awful"], rng.randrange(1, 3))
            if rng.random() < 0.8:  # a biased sample: the group is mentioned in toxic texts
                w.append("muslim")
        rng.shuffle(w)
        rows.append((i, " ".join(w), toxic))
    return rows


def test_toxicity_of_held_out_texts_and_neutral_mentions(spark):
    rng = random.Random(2)
    rows = labelled(900, rng)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic").where("doc_id < 600")
    model = toxicity.train(docs.drop("toxic"), labels)
    got = {r["doc_id"]: r["s"] for r in collected(docs.select("doc_id", toxicity.scorer(model)("text").alias("s")))}
    assert all((got[i] >= 0.5) == bool(t) for i, _, t in rows if i >= 600)
    plain = toxicity.train(docs.drop("toxic"), labels, swap_weight=0.0)
    at = lambda m, w: m.weights[toxicity.features({w})].sum()
    assert abs(at(model, "muslim") - at(model, "christian")) < 0.5
    assert at(plain, "muslim") - at(plain, "christian") > 1  # without the penalty the mention alone counts as toxic


def test_swaps_stay_in_their_category_and_sentence():
    got = toxicity.swaps("An old house. Young and old! no", (("old", "young", "elderly"), ("house", "home")))
    assert got == {("old", "young", False): 1, ("old", "elderly", False): 2, ("house", "home", False): 1, ("young", "old", True): 1, ("young", "elderly", False): 1, ("old", "young", True): 1}
    assert not toxicity.swaps("a house") and not toxicity.swaps(None) and not toxicity.swaps("")
    out, put = toxicity.change(("elderly", "old", False))
    assert set(out) == set(toxicity.marks("elderly")) and set(put) == set(toxicity.marks("old"))
    assert len(toxicity.change(("elderly", "old", True))[1]) == 0


def rms(model, swaps):
    total = sum(n * (model.weights[a].sum() - model.weights[b].sum()) ** 2 for s, n in swaps.items() for a, b in [toxicity.change(s)])
    return (total / sum(swaps.values())) ** 0.5


def test_swap_penalty_acts_on_the_given_labels(spark, sf_dir):
    """Held-out sentences change their score less when their terms are swapped, and no toxic text is lost by that."""
    d = sf_dir.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    told = toxicity.training_labels(labels)
    fair, plain = toxicity.train(docs, told), toxicity.train(docs, told, swap_weight=0.0)
    assert not np.allclose(fair.weights, plain.weights)
    held = [(r["text"], r["toxic"]) for r in docs.join(labels.where(bucket_of("doc_id", 5) == 0), "doc_id").select("text", "toxic").collect()]
    swaps = sum((toxicity.swaps(t) for t, _ in held), start=toxicity.Counter())
    assert sum(swaps.values()) > 500 and rms(fair, swaps) < 0.05 * rms(plain, swaps)
    hit = {name: [model.logit(toxicity.features(toxicity.words(t))) >= 0 for t, _ in held] for name, model in (("fair", fair), ("plain", plain))}
    caught = {name: sum(h and y for h, (_, y) in zip(hs, held)) for name, hs in hit.items()}
    wrong = {name: sum(h and not y for h, (_, y) in zip(hs, held)) for name, hs in hit.items()}
    assert caught["fair"] >= max(caught["plain"], 0.85 * sum(y for _, y in held)) and wrong["fair"] <= min(wrong["plain"], 5)


def test_fit_is_the_least_plain_loss():
    """Against the loss written out densely: its gradient is nothing at the fitted weights, and steps away only raise it."""
    rng = np.random.default_rng(4)
    rows = [(int(rng.random() < 0.4), np.unique(rng.integers(0, 12, rng.integers(1, 6))).astype(np.int32)) for _ in range(120)]
    pairs = [(np.array([0], np.int32), np.array([1], np.int32), 3.0), (np.array([2, 3], np.int32), np.array([], np.int32), 1.0)]
    l2, weight = 1e-3, 0.7
    model = toxicity.fit(rows, pairs, least=1, noise=0.0, l2=l2, swap_weight=weight)
    x = np.zeros((len(rows), 12))
    for k, (_, at) in enumerate(rows):
        x[k, at] = 1
    y = np.array([r[0] for r in rows])
    share = np.clip(x.mean(0), 1 / len(y), 0.5)
    scale = (share * (1 - share)) ** -0.5

    def loss(w, b):
        z = x @ w + b
        moved = (3 * (w[0] - w[1]) ** 2 + (w[2] + w[3]) ** 2) / 4
        return np.mean(np.log(1 + np.exp(-z * (2 * y - 1)))) + weight * moved + l2 / 2 * np.sum((w / scale) ** 2)

    w, b = model.weights[:12], model.bias
    best = loss(w, b)
    for k in range(13):
        for h in (1e-3, -1e-3, 0.1, -0.1):
            step = h * np.eye(13)[k]
            assert loss(w + step[:12], b + step[12]) >= best - 1e-9
        e = 1e-5 * np.eye(13)[k]
        assert abs(loss(w + e[:12], b + e[12]) - loss(w - e[:12], b - e[12])) / 2e-5 < 1e-5


def test_labels_missing_repeated_or_null(spark):
    docs = documents(spark, extra=True)
    labels = spark.createDataFrame([(0, 1), (0, 0), (3, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = docs.select("doc_id", toxicity.scorer(model)("text").alias("s")).collect()
    assert len(out) == docs.count() and all(0 <= r.s <= 1 for r in out)
    empty = toxicity.train(docs, labels.limit(0))
    assert all(r.s < 0.01 for r in docs.select(toxicity.scorer(empty)("text").alias("s")).collect())
    assert toxicity.train(nothing(spark), labels).bias < 0


def test_the_sample_of_labels_bounds_the_rows(spark, monkeypatch):
    """One labelled doc_id in thousands of rows gives one text."""
    rows = [(1, f"row {k}", "en", "s", 0) for k in range(3000)] + [(k, "fine words" if k % 2 else "idiot words", "en", "s", 0) for k in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(1, 30)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, *a, **k: seen.append(len(rows)))
    toxicity.train(docs, labels, sample=29)
    assert seen == [29]


def test_languages_are_learned_without_ids(spark):
    """Rows without doc_id are drawn by their text, and no more than the bound."""
    words = {"en": "the and with from that", "fr": "le une avec dans pour"}
    rows = [(None, f"{w} {k} {w[::-1]}", lang, None, None) for lang, w in words.items() for k in range(2000)] + [(None, "the same text", "en", None, None)] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.train(docs, per_lang=100)
    assert model.langs == ["en", "fr"] and model.weights.any()
    assert model.predict("le une avec")[0] == "fr" and model.predict("and with that")[0] == "en"
