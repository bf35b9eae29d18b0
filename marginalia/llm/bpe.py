"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

The encoding of a prefix is fixed by one number, its *last token*: dropping that
token leaves the encoding of a shorter prefix.  So the distinct words of a batch go
into a trie, a depth-first walk gives each node its last token from the nodes above
it, and prefixes that several words share are worked out once.

A token ``t`` ends the encoding of a prefix if its bytes end the prefix and no merge
crosses the border between the last token of what is left and ``t``.  Exactly one
token does.

Edge cases: null text counts as empty and gives no ids; strings of special tokens
inside a text become that special token; very long texts, also those of one word, are
encoded whole, a batch at a time, in time that follows their length; repeated rows give
repeated results; an empty table gives an empty result; other columns of the input,
also of the names used here, play no part.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from marginalia.llm.common import small_batches, table

#: Words of one trie, words and pairs kept between batches; these bound memory only.
TRIE_WORDS, KEPT_WORDS, KEPT_PAIRS = 50_000, 400_000, 400_000
#: Longer words aren't kept between batches, so that the words kept are bounded in bytes too.
KEPT_CHARS = 64

# Fixed value: the public pre-tokenisation pattern of byte-level BPE vocabularies,
# with white space as Unicode has it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in a vocabulary file: printable ones are themselves, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBPE:
    """Encoder and decoder over a byte-level ``tokenizer.json``."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.reach: dict[bytes, int] = {}  # the longest token that ends with four bytes
        for b in self.ids:
            if len(b) > 3 and self.reach.get(b[-4:], 0) < len(b):
                self.reach[b[-4:]] = len(b)
        self.packed = {i: i.to_bytes(4, "little") for i in self.bytes}
        self.ranks: dict[tuple[int, int], int] = {}
        self.made_of: dict[int, tuple[int, int, int]] = {}
        self.edges: dict[int, list[tuple[int, float]]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            self.ranks[self.ids[left], self.ids[right]] = rank
            self.made_of.setdefault(self.ids[left + right], (self.ids[left], self.ids[right], rank))
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PIECES)
        self.wide = max(self.bytes) + 1
        self.stable: dict[int, bool] = {}  # by (last token + 1) * wide + token
        self.kept: dict[str, bytes] = {}

    def edge(self, token: int, right: bool) -> list[tuple[int, float]]:
        """Tokens that stand at one edge while ``token`` is merged, each with the rank of the merge that ends it."""
        key = 2 * token + right
        if key not in self.edges:
            out, death = [], float("inf")
            while True:
                out.append((token, death))
                if token not in self.made_of:
                    break
                left, r, death = self.made_of[token]
                token = r if right else left
            self.edges[key] = out
        return self.edges[key]

    def fits(self, before: int, token: int) -> bool:
        """Whether ``token`` can follow ``before``: no merge across their border comes before those inside them.

        Of equal ranks the leftmost merge comes first.  -1 stands for the word's start.
        """
        key = (before + 1) * self.wide + token
        ok = self.stable.get(key)
        if ok is None:
            if len(self.stable) > KEPT_PAIRS:
                self.stable.clear()
            ok = True
            if before >= 0:
                rank = self.ranks.get
                for x, x_ends in self.edge(before, True):
                    for y, y_ends in self.edge(token, False):
                        r = rank((x, y))
                        if r is not None and r < x_ends and r <= y_ends:
                            ok = False
            self.stable[key] = ok
        return ok

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct words, packed as little-endian unsigned 32-bit integers.

        The sorted words are the trie's depth-first order: each word enters below the
        node where it parts from the one before, and finds the states of the path to it.
        """
        found: dict[str, bytes] = {}
        ids, reach, stable, fits, packed, wide = self.ids.get, self.reach.get, self.stable.get, self.fits, self.packed, self.wide
        last, back, prev = [-1], [0], b""  # last token, and the length before it, of each prefix on the path
        for word, text in sorted((t.encode("utf-8", "surrogatepass"), t) for t in words):
            n, shared = len(word), 0
            if len(last) <= n:
                last += [-1] * n
                back += [0] * n
            for x, y in zip(prev, word):
                if x != y:
                    break
                shared += 1
            for depth in range(shared + 1, n + 1):
                least = depth - reach(word[depth - 4 : depth], 3) if depth > 3 else 0
                for start in range(least if least > 0 else 0, depth):
                    token = ids(word[start:depth])
                    if token is not None:
                        ok = stable((last[start] + 1) * wide + token)
                        if ok or ok is None and fits(last[start], token):
                            last[depth], back[depth] = token, start
                            break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            out, d = [], n
            while d:
                out.append(packed[last[d]])
                d = back[d]
            out.reverse()
            found[text] = b"".join(out)
            prev = word
        return found

    def cut(self, text: str) -> list[str]:
        """Words and special tokens of a text, in order; joined they are the text."""
        if self.split is None or not any(s in text for s in self.special):
            return self.pieces.findall(text)
        return [w for part in self.split.split(text) if part for w in ([part] if part in self.special else self.pieces.findall(part))]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        cuts = [self.cut(t) if t else [] for t in texts]
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        self.kept.update((s, self.packed[i]) for s, i in self.special.items())
        new = list(set().union(*cuts) - self.kept.keys())
        for i in range(0, len(new), TRIE_WORDS):
            self.kept.update(self.encode_words(new[i : i + TRIE_WORDS]))
        get = self.kept.__getitem__
        out = [b"".join(map(get, c)) for c in cuts]
        for w in new:
            if len(w) > KEPT_CHARS:
                del self.kept[w]
        return out

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> TrieBPE:
    """One tokenizer for each worker process and file."""
    return TrieBPE(path)


def default_path() -> str:
    """The vocabulary's place on this machine; each executor has its own copy of the package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _mapped(df: DataFrame, fn, out: pa.Schema, schema: str, path: str | None) -> DataFrame:
    def run(batches):
        pa.default_memory_pool().release_unused()  # what earlier tasks of this worker have left
        bpe = tokenizer(path or default_path())
        for b in batches:
            if b.num_rows:
                cols = fn(bpe, b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0).cast(out.field(0).type), *(pa.array(c, f.type) for c, f in zip(cols, list(out)[1:]))], schema=out)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids``: the whole text's token ids."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def fn(bpe, texts):
        packed = bpe.encode_batch(texts)
        return [len(p) // 4 for p in packed], [np.frombuffer(p, "<u4").astype("int64") for p in packed]

    return _mapped(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), fn, out, "doc_id long, n_tokens long, ids array<long>", path)


def decode(ids: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give an empty text."""
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def fn(bpe, rows):
        return ([bpe.decode(np.asarray(r or [], "<u4").tobytes()) for r in rows],)

    return _mapped(ids.select("doc_id", "ids"), fn, out, "doc_id long, text string", path)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each text: encoded, then decoded from the ids."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def fn(bpe, texts):
        packed = bpe.encode_batch(texts)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        return [len(p) // 4 for p in packed], [digest(p) for p in packed], [digest(bpe.decode(p).encode()) for p in packed]

    return _mapped(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), fn, out, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", path)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
