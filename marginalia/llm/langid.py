"""Language identification from TF-IDF character n-grams.

Sparse multinomial logistic regression, trained with follow-the-regularised-leader
(per-coordinate rates, elastic net), then calibrated with one temperature.  N-grams of
one to three characters of the lower-cased whole text are hashed to ``2 ** bits``
features.  Document frequencies are counted over every document one may learn from;
the model is fitted on a bounded sample of them, about ``per_lang`` for each language
and at most a quarter more, drawn by a hash of doc_id and text.  A language is learned
if at least ``least_docs`` documents have it; of more than ``most_langs`` the most
frequent are, which bounds the model.  All three are parameters.

The weights that aren't nothing go to the executors as one broadcast variable.

Edge cases: null texts and texts without letters are ``und`` with score 0; rows with
null lang aren't learned from; rows without doc_id, or of one doc_id, are drawn each by
its text, and of many equal rows no more than the bound; with no language to learn, all are ``und``; ties go to
the first language by name; repeated rows give repeated results; very long texts are
counted whole, a batch at a time; an empty table gives an empty result; other columns,
also of the names used here, play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.common import bucket_of, small_batches, table

BITS, ORDERS = 15, 3
SIZE = 1 << BITS
MIX = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)]


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram stands in the text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    grams, h = [], np.zeros(len(points), np.uint32)
    for n in range(ORDERS):
        if len(points) <= n:
            break
        h = (h[: len(points) - n] ^ (points[n:] + np.uint32(n + 1))) * MIX[n]
        h ^= h >> np.uint32(15)
        grams.append((h * MIX[0]) >> np.uint32(32 - BITS))
    return np.bincount(np.concatenate(grams).astype(np.int64), minlength=SIZE) if grams else np.zeros(SIZE, np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray  # of SIZE
    weights: np.ndarray  # SIZE by languages
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(c)
        x = np.log1p(c[at]) * self.idf[at]
        return at, x / max(1e-12, float(np.sqrt(x @ x)))

    def logits(self, c: np.ndarray) -> np.ndarray:
        at, x = self.vector(c)
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        p = softmax(self.logits(counts(text)) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


class Slim(Model):
    """A model that keeps only the rows of weights that aren't nothing."""

    def __init__(self, langs: list[str], idf: np.ndarray, place: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float) -> None:
        super().__init__(langs, idf, weights, bias, temperature)
        self.place = place

    def logits(self, c: np.ndarray) -> np.ndarray:
        at, x = self.vector(c)
        return x @ self.weights[self.place[at]] + self.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, epochs: int = 4, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights (SIZE by classes) and bias from rows of class, features and values."""
    z, n = np.zeros((SIZE + 1, classes)), np.zeros((SIZE + 1, classes))
    free = lambda a: np.where(a == SIZE, 0.0, l1)[:, None]  # noqa: E731  the bias isn't shrunk

    def weights(at: np.ndarray) -> np.ndarray:
        s, pull = z[at], free(at)
        return np.where(np.abs(s) <= pull, 0.0, (np.sign(s) * pull - s) / ((beta + np.sqrt(n[at])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, at, x = rows[k]
            at, x = np.append(at, SIZE), np.append(x, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / alpha * w
    full = weights(np.arange(SIZE + 1))
    return full[:-1], full[-1]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The one of a fixed grid with the least log loss."""
    grid = np.geomspace(0.02, 20, 121)

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    return float(min(grid, key=loss)) if len(y) else 1.0


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts each feature stands, and how many texts there are."""
    out = pa.schema([("at", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(SIZE + 1, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                total[:-1] += counts(t) > 0
                total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], schema=out)

    got = docs.mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # 2 ** bits + 1 rows at most
    df = np.zeros(SIZE + 1, np.int64)
    df[got["at"].to_numpy()] = got["n"].to_numpy()
    return df[:-1], int(df[-1])


def train(docs: DataFrame, per_lang: int = 800, least_docs: int = 5, most_langs: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the rows of ``docs`` that have a text and a language."""
    small_batches(docs.sparkSession)
    known = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).where("text is not null and lang is not null")
    often = known.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs).orderBy(F.desc("n"), "lang").limit(most_langs)
    sizes = {r["lang"]: r["n"] for r in often.collect()}  # most_langs rows at most
    known = known.where(F.col("lang").isin(*sizes)) if sizes else known.limit(0)
    langs = sorted(sizes)
    df, n = document_frequencies(known.select("text"))
    model = Model(langs, np.log((1 + n) / (1 + df)) + 1, np.zeros((SIZE, max(1, len(langs)))), np.zeros(max(1, len(langs))))
    if not langs:
        return model
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, per_lang / size)) for lang, size in sizes.items()], "lang string, share double")
    drawn = F.pmod(F.xxhash64("id", "text", F.lit(11)), F.lit(1_000_000)) < F.col("share") * 1_000_000
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id", "text", F.lit(11))))
    out = pa.schema([("lang", pa.string()), ("held", pa.bool_()), ("at", pa.binary()), ("n", pa.binary())])

    def run(batches):
        for b in batches:
            cs = [counts(t) for t in b.column(2).to_pylist()]
            at = [np.flatnonzero(c).astype(np.int32) for c in cs]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([c[a].astype(np.int32).tobytes() for a, c in zip(at, cs)], pa.binary())], schema=out)

    held = F.pmod(F.xxhash64("id", "text", F.lit(12)), F.lit(5)) == 0
    chosen = known.join(F.broadcast(shares), "lang").where(drawn).withColumn("nth", nth).where(F.col("nth") <= per_lang + per_lang // 4)
    rows = chosen.select("lang", held.alias("held"), "text").mapInArrow(run, "lang string, held boolean, at binary, n binary").toArrow().to_pylist()
    fold: dict[bool, list] = {True: [], False: []}
    for r in sorted(rows, key=lambda r: (r["lang"], r["at"], r["n"])):
        c = np.zeros(SIZE, np.int64)
        c[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["n"], np.int32)
        fold[r["held"]].append((langs.index(r["lang"]), *model.vector(c)))
    model.weights, model.bias = ftrl(fold[False] or fold[True], len(langs))
    if fold[True]:
        z = np.array([x @ model.weights[at] + model.bias for _, at, x in fold[True]])
        model.temperature = temperature(z, np.array([y for y, _, _ in fold[True]]))
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text."""
    small_batches(docs.sparkSession)
    used = np.flatnonzero(model.weights.any(1))
    place = np.full(SIZE, len(used), np.int32)  # the last row of the weights is nothing
    place[used] = np.arange(len(used))
    weights = np.vstack([model.weights[used], np.zeros((1, model.weights.shape[1]))]).astype(np.float32)
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.idf.astype(np.float32), place, weights, model.bias, model.temperature))
    out = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        slim = Slim(*sent.value)
        for b in batches:
            found = [slim.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], schema=out)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(bucket_of("doc_id", 4) != 2))
    found = predict(docs, model)
    return found.select("doc_id", (bucket_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
