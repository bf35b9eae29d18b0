"""Toxicity scores from a counterfactual-regularised linear classifier.

A logistic model over the words of a whole text and their beginnings.  In every
sentence of a labelled text that mentions an identity group, each such term is swapped
for each of its siblings, and the training loss adds ``swap_weight`` times the mean
squared change of the sentence's logit.  So group mentions by themselves don't move a
score.  The terms (pronouns and group names in four languages) are a parameter.

As the model is linear, a swap changes a sentence's logit only by the features that it
takes out and puts in; so equal swaps are counted, and every swap in every sentence
counts, however long the text.

Features are hashed to ``2 ** bits`` numbers; only those in at least ``least`` labelled
texts count.  The classifier is fitted on at most ``sample`` labelled rows, those of
the smallest hash of doc_id, a documented bound; every text is scored whole.

Edge cases: null and empty texts have no words and get the score of the bias alone;
null labels aren't learned from; a doc_id labelled twice counts as toxic if either
row says so; without any labels every score is next to 0; an empty table gives an empty
result; very long texts are scored whole, a batch at a time; scores of 0.5 count as
toxic; rows that repeat get equal scores; other columns, also of the names used here,
play no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import bucket_of, small_batches, table

# Identity terms by category; a term is swapped for the others of its category.
IDENTITY = (
    ("he", "she", "they"),
    ("him", "her", "them"),
    ("his", "hers", "theirs"),
    ("il", "elle"),
    ("ils", "elles"),
    ("er", "sie"),
    ("ihm", "ihr"),
    ("él", "ella"),
    ("ellos", "ellas"),
    ("el", "la"),
    ("los", "las"),
    ("un", "une"),
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("female", "male", "nonbinary", "transgender"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "sikhs"),
    ("black", "white", "asian", "latino", "indigenous", "arab"),
    ("african", "european", "american", "mexican", "chinese", "indian"),
    ("immigrant", "refugee", "citizen", "native"),
    ("immigrants", "refugees", "citizens", "natives"),
    ("old", "young", "elderly", "teenage"),
    ("alte", "junge"),
    ("vieux", "jeune"),
    ("viejo", "joven"),
    ("disabled", "blind", "deaf", "autistic"),
)
Groups = tuple[tuple[str, ...], ...]
WORD, SENTENCE = re.compile(r"\w+"), re.compile(r"[.!?\n]+")
BITS = 18
MASK = (1 << BITS) - 1
#: Lengths of the beginnings of words that count as features.
STEMS = (5, 6, 7)
#: Words whose features a worker keeps; this bounds memory only.
KEPT_WORDS = 200_000


def siblings(groups: Groups) -> dict[str, list[str]]:
    """For each identity term the terms that it is swapped for."""
    return {w: [x for x in group if x != w] for group in groups for w in group}


def words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def marks(word: str) -> list[int]:
    """Feature numbers of a word: itself, and its beginnings if it is longer than they."""
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & MASK for x in (word, *("^" + word[:k] for k in STEMS if len(word) > k))]


def features(found: set[str]) -> np.ndarray:
    """Sorted distinct feature numbers of a set of words."""
    return np.unique(np.array([m for w in found for m in marks(w)], np.int32))


def swaps(text: str | None, groups: Groups = IDENTITY) -> Counter:
    """How often each swap can be made in the text's sentences: ``(term, sibling, whether the sentence has the sibling too)``."""
    out, known = Counter(), siblings(groups)
    for sentence in SENTENCE.split(text.lower()) if text else ():
        found = set(WORD.findall(sentence))
        out.update((w, x, x in found) for w in found & known.keys() for x in known[w])
    return out


def change(swap: tuple[str, str, bool]) -> tuple[np.ndarray, np.ndarray]:
    """The features that a swap takes out of a sentence, and those that it puts in."""
    term, sibling, there = swap
    out, put = set(marks(term)), set(marks(sibling))
    return np.array(sorted(out - put), np.int32), np.array([] if there else sorted(put - out), np.int32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> float:
        return float(self.weights[x].sum()) + self.bias


def fit(rows: list[tuple[int, np.ndarray]], pairs: list[tuple[np.ndarray, np.ndarray, float]] = (), least: int = 5, noise: float = 2.5, l2: float = 3e-4, swap_weight: float = 1.0, steps: int = 120) -> Model:
    """Fit on label and features; ``pairs``: features that a swap takes out and puts in, and how often.

    First an L1 fit by accelerated proximal gradient over features of equal variance:
    its penalty is ``noise`` times the deviation that chance gives a feature's gradient,
    so words that only happen to stand in toxic texts get no weight.  Then a refit of
    the words left, and of all identity terms, with a ridge of ``l2``.  Both carry the
    penalty on swaps.
    """
    size = 1 << BITS
    none = np.zeros(0, np.int32)
    if not rows:
        return Model(np.zeros(size), -50.0)
    y, sets = np.array([r[0] for r in rows], float), [r[1] for r in rows]
    times = np.array([p[2] for p in pairs], float)
    times = times / max(1.0, times.sum())
    rate = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))

    def screen(cols: np.ndarray, scale: np.ndarray, l1: float, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        to = np.full(size, -1)
        to[cols] = np.arange(len(cols))

        def pack(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            kept = [k[k >= 0] for k in (to[s] for s in lists)]
            return np.concatenate([none, *kept]).astype(int), np.repeat(np.arange(len(kept)), [len(k) for k in kept])

        (xi, xr), (oi, orow), (pi, prow) = pack(sets), pack([p[0] for p in pairs]), pack([p[1] for p in pairs])

        def pull(ws: np.ndarray) -> np.ndarray:
            """Half the gradient of the mean squared change of swapped sentences."""
            d = times * (np.bincount(orow, ws[oi], len(pairs)) - np.bincount(prow, ws[pi], len(pairs)))
            return np.bincount(oi, d[orow], len(cols)) - np.bincount(pi, d[prow], len(cols))

        def gradient(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
            ws = w * scale
            z = np.bincount(xr, ws[xi], len(y)) + b
            g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(y)
            out = np.bincount(xi, g[xr], len(cols))
            if len(pairs):
                out = out + 2 * swap_weight * pull(ws)
            return out * scale, float(g.sum())

        u = np.ones(len(cols)) / max(1, len(cols)) ** 0.5  # the largest curvature, by power iteration
        top = 1.0
        for _ in range(12):
            v = 0.25 * np.bincount(xi, (np.bincount(xr, (u * scale)[xi], len(y)) / len(y))[xr], len(cols)) * scale
            if len(pairs):
                v = v + 2 * swap_weight * pull(u * scale) * scale
            top = float(np.linalg.norm(v)) or 1.0
            u = v / top
        step = 1 / (1.2 * top + 0.3)
        w1, b1, t = w, b, 1.0
        for _ in range(steps):
            g, gb = gradient(w1, b1)
            w2 = w1 - step * g
            w2 = np.sign(w2) * np.maximum(0, np.abs(w2) - step * l1)
            b2 = b1 - step * gb
            t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
            if (w1 - w2) @ (w2 - w) + (b1 - b2) * (b2 - b) > 0:
                t2 = 1.0  # the step overshot: start the acceleration anew
            w1, b1 = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
            w, b, t = w2, b2, t2
        return w, b

    seen = np.bincount(np.concatenate([none, *sets]), minlength=size)
    named = np.unique(np.concatenate([none, *(x for p in pairs for x in p[:2])]).astype(int))
    cols = np.union1d(np.flatnonzero(seen >= least), named)
    share = np.clip(seen[cols] / len(y), min(0.5, least / len(y)), 0.5)
    scale = 1 / np.sqrt(share * (1 - share))
    w, b = screen(cols, scale, noise * (rate * (1 - rate) / len(y)) ** 0.5, np.zeros(len(cols)), float(np.log(rate / (1 - rate))))
    kept = np.flatnonzero((w != 0) | np.isin(cols, named))
    cols, scale = cols[kept], scale[kept]
    full = np.zeros(size)
    w, b = refit(y, sets, pairs, times, cols, scale, l2, swap_weight, b)
    full[cols] = w * scale
    return Model(full, b)


def dense(lists: list[np.ndarray], cols: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """A row for each list of features, a column for each of ``cols`` (sorted): its scale where the list has it."""
    out = np.zeros((len(lists), len(cols)))
    for k, x in enumerate(lists):
        at = np.flatnonzero(np.isin(cols, x, assume_unique=True))
        out[k, at] = scale[at]
    return out


def refit(y: np.ndarray, sets: list[np.ndarray], pairs: list, times: np.ndarray, cols: np.ndarray, scale: np.ndarray, l2: float, swap_weight: float, b: float, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Weights and bias of the least ridge and swap loss over few features, by damped Newton steps."""
    change_by = dense([p[0] for p in pairs], cols, scale) - dense([p[1] for p in pairs], cols, scale)
    stiff = 2 * swap_weight * change_by.T @ (times[:, None] * change_by) + l2 * np.eye(len(cols))
    blocks = [(dense(sets[i : i + 1000], cols, scale), y[i : i + 1000]) for i in range(0, len(y), 1000)]
    w = np.zeros(len(cols))

    def loss(w: np.ndarray, b: float) -> float:
        return sum(float(np.sum(np.logaddexp(0, x @ w + b) - t * (x @ w + b))) for x, t in blocks) / len(y) + 0.5 * float(w @ stiff @ w)

    now = loss(w, b)
    for _ in range(rounds):
        g, h = np.append(stiff @ w, 0.0), np.zeros((len(cols) + 1, len(cols) + 1))
        h[:-1, :-1] = stiff
        h[-1, -1] = 1e-9
        for x, t in blocks:
            p = 1 / (1 + np.exp(-np.clip(x @ w + b, -50, 50)))
            g += np.append(x.T @ (p - t), (p - t).sum()) / len(y)
            v = p * (1 - p) / len(y)
            h[:-1, :-1] += x.T @ (v[:, None] * x)
            h[:-1, -1] += x.T @ v
            h[-1, :-1] += x.T @ v
            h[-1, -1] += v.sum()
        step, size = np.linalg.solve(h, g), 1.0
        while (after := loss(w - size * step[:-1], b - size * step[-1])) > now and size > 1e-6:
            size /= 2
        w, b = w - size * step[:-1], b - size * step[-1]
        if now - after < 1e-12:
            break
        now = after
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, sample: int = 12_000, groups: Groups = IDENTITY, id_col: str = "doc_id", text_col: str = "text", **how) -> Model:
    """Fit on at most ``sample`` rows of ``labels`` (doc_id, toxic), chosen by hash of doc_id.

    A labelled doc_id gives one text, whatever its rows in ``docs``: the smallest.
    """
    small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text")  # the sample's size is a parameter
    counted = pa.list_(pa.struct([("term", pa.string()), ("sibling", pa.string()), ("there", pa.bool_()), ("n", pa.int64())]))
    out = pa.schema([("toxic", pa.int32()), ("x", pa.binary()), ("swaps", counted)])

    def run(batches):
        for b in batches:
            told = b.column(1).to_pylist()
            swapped = [[{"term": s[0], "sibling": s[1], "there": s[2], "n": n} for s, n in swaps(t, groups).items()] for t in told]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(words(t)).tobytes() for t in told], pa.binary()), pa.array(swapped, counted)], schema=out)

    got = joined.mapInArrow(run, "toxic int, x binary, swaps array<struct<term string, sibling string, there boolean, n long>>").toArrow().to_pylist()
    total = Counter()
    for r in got:
        for s in r["swaps"]:
            total[s["term"], s["sibling"], s["there"]] += s["n"]
    return fit(sorted(((r["toxic"], np.frombuffer(r["x"], np.int32)) for r in got), key=lambda r: (r[0], r[1].tobytes())), [(*change(s), n) for s, n in sorted(total.items())], **how)


def scorer(model: Model):
    """A Spark column function: text to score."""
    used = np.flatnonzero(model.weights)
    kept, bias = dict(zip(used.tolist(), model.weights[used].tolist())), model.bias

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            hit: set[int] = set()
            for w in words(t):
                m = weighed.get(w)
                if m is None:
                    if len(weighed) >= KEPT_WORDS:
                        weighed.clear()
                    m = weighed[w] = tuple(x for x in marks(w) if x in kept)
                hit.update(m)
            z = bias + sum(kept[h] for h in sorted(hit))
            out.append(1 / (1 + np.exp(-min(50.0, max(-50.0, z)))))
        return pd.Series(out, dtype="float64")

    weighed: dict[str, tuple[int, ...]] = {}
    return score


def training_labels(labels: DataFrame) -> DataFrame:
    """The contract's training fold: ``crc32(doc_id as text) mod 5`` is not 0."""
    return labels.where(bucket_of("doc_id", 5) > 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, training_labels(table(spark, sf_dir, "labels")))
    scored = docs.select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), scorer(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
