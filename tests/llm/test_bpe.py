"""BPE against the tokenizers library, and exact round trips."""

import hashlib
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marginalia.llm import bpe
from tests.llm.fixtures import collected, documents, nothing


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def ours():
    return bpe.tokenizer(bpe.default_path())


def ids_of(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    t, lib = bpe.tokenizer(bpe.default_path()), Tokenizer.from_file(bpe.default_path()) if not hasattr(test_any_text, "lib") else test_any_text.lib
    test_any_text.lib = lib
    packed = t.encode_batch([text])[0]
    assert ids_of(packed) == lib.encode(text, add_special_tokens=False).ids
    assert t.decode(packed) == text


@pytest.mark.parametrize("text", ["", " ", "<|endoftext|>", "a<|endoftext|> b", "<|endoftext", "don't WE'LL 'S", "a" * 5000, "ab" * 2500 + "\n\n x", "\x85\xa0  　x", "\x1c\x1d\x1e", "١٢٣ ½Ⅷ", "é 🏳️‍🌈", "0" * 3000])
def test_awkward_texts(library, ours, text):
    packed = ours.encode_batch([text])[0]
    assert ids_of(packed) == library.encode(text, add_special_tokens=False).ids
    assert ours.decode(packed) == library.decode(ids_of(packed), skip_special_tokens=False) == text


def test_every_character(library, ours):
    texts = ["".join(f"{chr(c)} a{chr(c)}" for c in range(s, s + 256) if not 0xD800 <= c < 0xE000) for s in range(0, 0x20000, 256)]
    assert [ids_of(p) for p in ours.encode_batch(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_small_tables_change_nothing(ours, monkeypatch):
    texts = [f"some words {k} and more{k}" for k in range(50)]
    want = ours.encode_batch(texts)
    monkeypatch.setattr(bpe, "TRIE_WORDS", 3)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 5)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 5)
    assert bpe.TrieBPE(bpe.default_path()).encode_batch(texts) == want


def test_query_columns(spark, library):
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in collected(bpe.round_trip(documents(spark, extra=True)))}
    want = set()
    for r in documents(spark).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == want
    assert bpe.round_trip(documents(spark)).count() == documents(spark).count()


def test_encode_then_decode(spark):
    back = {(r["doc_id"], r["text"]) for r in collected(bpe.decode(bpe.encode(documents(spark))))}
    assert back == {(r.doc_id, r.text or "") for r in documents(spark).collect()}


def test_no_rows(spark):
    assert bpe.round_trip(nothing(spark)).count() == 0
