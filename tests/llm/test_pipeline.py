"""Each stage of the pipeline against a brute-force version, and the whole run."""

import re
import struct

import corpus_pipeline as P
import numpy as np
import pytest
from tokenizers import Tokenizer

from marginalia.llm import bpe, decontaminate, secrets, toxicity
from tests.llm.fixtures import collected, documents, nothing, prose
from tests.llm.test_minhash import brute
from marginalia.llm.minhash import Setting


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def key(df):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in collected(df)), key=str)


def test_stages_are_the_agreed_ones():
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "tokens"]


def test_toxic_documents_go_and_clean_ones_stay(spark, docs, sf_dir):
    out = P.without_toxic(spark, docs, sf_dir)
    assert out.columns == docs.columns
    model = toxicity.train(docs, toxicity.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    want = {r["doc_id"] for r in collected(docs) if model.logit(toxicity.features(toxicity.words(r["text"]))) < 0}
    assert {r["doc_id"] for r in collected(out)} == want


def test_one_document_of_each_group_stays(spark, docs, sf_dir):
    want = {i for i, (_, c) in brute([(r["doc_id"], r["text"]) for r in collected(docs)], Setting()).items() if i == c}
    assert key(P.without_copies(spark, docs, sf_dir)) == [k for k in key(docs) if k[0] in want]


def near_items(texts, items):
    """For each text whether an item lies in it within its budget: the whole edit matrix, a row of all texts at a time."""
    gap = 300  # a stretch across two texts costs more than any budget
    spaced = "".join(f" {t} " + "\0" * gap for t in texts)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 + gap for t in texts])
    chars, at = np.array([ord(c) for c in spaced]), np.arange(len(spaced) + 1)
    out = np.zeros(len(texts), bool)
    for item in items:
        row = np.zeros(len(spaced) + 1, np.int64)
        for i, c in enumerate(f" {item} ", 1):
            step = np.minimum(row[:-1] + (chars != ord(c)), row[1:] + 1)
            step = np.concatenate([[i], step])
            row = np.minimum.accumulate(step - at) + at
        out[np.unique(owner[row[1:] <= int(len(item) * decontaminate.RATE)])] = True
    return out


def test_leaking_documents_go(spark, docs, sf_dir):
    items = [decontaminate.normal(r["text"]) for r in collected(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))]
    assert min(len(i.split()) for i in items) >= decontaminate.LEAST_WORDS
    rows = [(r["doc_id"], decontaminate.normal(r["text"])) for r in collected(docs)]
    hit = near_items([t for _, t in rows], items)
    want = {i for (i, _), h in zip(rows, hit) if not h}
    assert {r["doc_id"] for r in collected(P.without_benchmark(spark, docs, sf_dir))} == want and 0 < len(want) < len(rows)


def test_leaks_are_judged_row_by_row(spark, docs, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [(None, f"so {item} it is"), (None, "clean"), (7, f"so {item} it is"), (7, "clean too"), (8, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], docs.schema)
    got = collected(P.without_benchmark(spark, df, sf_dir))
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(None, "clean"), (7, "clean too"), (8, None)], key=str)


def test_secrets_are_taken_out(spark, docs, sf_dir):
    before = {r["doc_id"]: r["text"] for r in collected(docs)}
    out = collected(P.without_secrets(spark, docs, sf_dir))
    assert len(out) == len(before)
    for r in out:
        assert r["text"] == secrets.redact_text(before[r["doc_id"]]) and r["n_chars"] == len(r["text"])
        assert not re.search(r"[0-9a-f]{40}", r["text"])


def test_tokens_decode_to_the_text(spark, docs, sf_dir):
    lib = Tokenizer.from_file(bpe.default_path())
    text = {r["doc_id"]: r["text"] for r in collected(docs)}
    for r in collected(P.tokenized(spark, docs, sf_dir)):
        assert r["ids"] == lib.encode(text[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def test_whole_run_chains_the_stages(spark, docs, sf_dir):
    step = docs
    for _, f in P.STAGES:
        step = f(spark, step, sf_dir)
    assert sorted((r["doc_id"], struct.pack(f"{len(r['ids'])}i", *r["ids"])) for r in collected(P.run(spark, sf_dir))) == sorted((r["doc_id"], struct.pack(f"{len(r['ids'])}i", *r["ids"])) for r in collected(step))


def test_awkward_rows_pass_every_stage(spark, sf_dir):
    df = documents(spark, extra=True)
    for name, f in P.STAGES[:-1]:
        out = f(spark, df, sf_dir)
        assert out.columns == df.columns, name
        assert {None, 4, 5, 6} <= {r["doc_id"] for r in collected(out)} or name == "near_duplicates"
        assert f(spark, nothing(spark), sf_dir).count() == 0
    tokens = collected(P.tokenized(spark, df, sf_dir))
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in tokens if r["doc_id"] in (None, 4, 5))[:2] == [("4", 0), ("5", 0)] and len(tokens) == df.count()
    assert P.tokenized(spark, nothing(spark), sf_dir).count() == 0
    kept = [r["doc_id"] for r in collected(P.without_copies(spark, df, sf_dir))]
    assert sorted(kept, key=str) == sorted([0, 3, 4, 5, 6, 7, 9, 10, 12, 13, 14, 15], key=str)  # the row without id copies 3


def test_copies_are_judged_by_id_and_text(spark, docs):
    """A row that copies another document goes, whatever else stands under its id; equal texts without id leave one."""
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    near = " ".join([*a.split()[:79], "changed"])
    rows = [(1, a), (2, near), (2, b), (2, b), (None, c), (None, c), (None, " ".join([*c.split()[:79], "other"])), (None, b), (None, None), (None, None), (None, ""), (3, None), (3, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], docs.schema)
    df = df.selectExpr("*", *(f"'x' as {n}" for n in ("_mark", "mark", "n", "stays", "id", "anonymous", "kept")))
    out = P.without_copies(spark, df, "")
    assert out.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in collected(out)), key=str)
    others = [r for r in got if r[0] is None and r[1] and r[1].startswith(c[:30])]
    assert len(others) == 1 and sorted(set(got) - set(others), key=str) == sorted({(1, a), (2, b), (None, None), (None, ""), (3, None)}, key=str)
    assert got.count((None, None)) == 2 and got.count((3, None)) == 1 and got.count((2, b)) == 1
    assert P.without_benchmark(spark, df, "/root/testdata/sf0.001").columns == df.columns
    assert {r["_mark"] for r in collected(P.without_benchmark(spark, df, "/root/testdata/sf0.001"))} == {"x"}
