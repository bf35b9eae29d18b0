"""Secret scanning: keyword automaton, anchored patterns near its hits, checksums.

An Aho-Corasick automaton over fixed keywords passes once over a text.  Each hit
starts an anchored pattern at its own place, so patterns never scan the text.  Kinds
that carry a checksum keep a match only if the checksum holds.  Bare hexadecimal runs
have no keyword; one class pattern finds them.

No pattern reads a stretch of text more than a fixed number of times: a match ends
where the next may begin, patterns of fixed length stop there, and a web token starts
only where no token character stands before it.  So time follows a text's length,
whatever is in it.

Edge cases: null and empty texts have no spans (the digest is that of an empty
string); an empty table gives an empty result; texts of many MB are scanned whole, one
batch at a time; offsets are code points; ties keep the listed order of kinds; repeated
rows give repeated results; other columns, also of the names used here, pass by
untouched.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
import zlib

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import small_batches, table

# The base kinds of the contract, then public token formats.
# kind: (keywords in lower case, whether case counts, pattern anchored at the keyword)
KINDS: dict[str, tuple[tuple[str, ...], bool, bytes]] = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"), False, rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": (("akia",), True, rb"(AKIA[A-Z0-9]+)"),
    "hex": ((), True, rb"([0-9a-f]{24,})"),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), True, rb"(gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "npm": (("npm_",), True, rb"(npm_[A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "gitlab": (("glpat-",), True, rb"(glpat-[A-Za-z0-9_-]{20,})"),
    "slack": (("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), True, rb"(xox[bpars]-[0-9]{6,}-[A-Za-z0-9-]{10,})"),
    "google": (("aiza",), True, rb"(AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9_-])"),
    "stripe": (("sk_live_", "rk_live_"), True, rb"([sr]k_live_[A-Za-z0-9]{20,})"),
    "jwt": (("eyj",), True, rb"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,})"),
    "pem": (("-----begin",), True, rb"(-----BEGIN (?:[A-Z]+ ){0,2}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ ){0,2}PRIVATE KEY-----)"),
}
BASE = ("assign", "access", "hex")
LEAST = {"assign": 6, "access": 20}
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_holds(token: bytes) -> bool:
    """The last six base-62 digits are the CRC-32 of the 30 characters after the prefix."""
    body, tail = token[4:-6], token[-6:].decode()
    n = 0
    for c in tail:
        n = 62 * n + DIGITS62.index(c)
    return n == zlib.crc32(body)


def jwt_holds(token: bytes) -> bool:
    """The first part decodes to a JSON object that names an algorithm."""
    head = token.split(b".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except (ValueError, TypeError, RecursionError):
        return False


CHECKS = {"github": crc_holds, "npm": crc_holds, "jwt": jwt_holds}


@functools.lru_cache(maxsize=1)
def automaton():
    auto = ahocorasick.Automaton()
    for kind, (words, _, _) in KINDS.items():
        for w in words:
            auto.add_word(w, (kind, len(w)))
    auto.make_automaton()
    return auto, {k: re.compile(p, 0 if exact else re.I) for k, (_, exact, p) in KINDS.items()}


def find(text: str | None) -> list[tuple[int, int, int, int, str]]:
    """``start, order of kind, end, start of the value, kind`` of each span, sorted; in code points."""
    if not text:
        return []
    auto, patterns = automaton()
    data = text.encode("utf-8", "surrogatepass")
    hits: dict[str, list[int]] = {}
    for end, (kind, n) in auto.iter(data.lower().decode("latin-1")):
        hits.setdefault(kind, []).append(end + 1 - n)
    spans = []
    order = {k: i for i, k in enumerate(KINDS)}
    for kind, starts in hits.items():
        over, match = 0, patterns[kind].match
        for at in sorted(set(starts)):
            if at >= over and (m := match(data, at)):
                over = m.end()
                if len(m[1]) >= LEAST.get(kind, 0) and (kind not in CHECKS or CHECKS[kind](m[1])):
                    spans.append((at, order[kind], over, m.start(1), kind))
    spans += [(m.start(), order["hex"], m.end(), m.start(), "hex") for m in patterns["hex"].finditer(data)]
    spans.sort()
    if len(data) != len(text):  # from bytes to code points, each part once
        places = sorted({p for s in spans for p in (s[0], s[2], s[3])})
        at, chars, to = 0, 0, {}
        for p in places:
            chars += len(data[at:p].decode("utf-8", "surrogatepass"))
            at = p
            to[p] = chars
        spans = [(to[a], o, to[b], to[v], k) for a, o, b, v, k in spans]
    return spans


def redact_text(text: str | None) -> str | None:
    """The text with each secret's value replaced by ``[secret]``; other text is unchanged."""
    spans = sorted((v, b) for _, _, b, v, _ in find(text))
    out, at = [], 0
    for a, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = b
    return text if not out else "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans array<struct<kind, start, end, value_start>>`` of each whole text."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64())]))
    out = pa.schema([("doc_id", pa.int64()), ("spans", kind)])

    def run(batches):
        for b in batches:
            rows = [[{"kind": k, "start": s, "end": e, "value_start": v} for s, _, e, v, k in find(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], schema=out)

    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind string, start long, end long, value_start long>>")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with the secrets' values taken out of ``text_col``."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(redact_text)

    small_batches(docs.sparkSession)
    return docs.withColumn(text_col, clean(docs[text_col]))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from what ``scan`` returns."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(n, BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents")))
