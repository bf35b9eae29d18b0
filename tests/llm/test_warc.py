"""Archives: round trip, revisits, the merged index."""

import base64
import gzip
import hashlib
import random

import pytest

from marginalia.llm import warc as W
from marginalia.llm.common import Stage
from tests.llm.fixtures import collected

ROWS = [
    (5, "http://a.example/x", "<p>one</p>"), (3, "https://www.A.example/x/#top", "<p>one</p>"), (9, "http://b.example/?b=2&a=1", "<p>one</p>"), (1, "http://c.example", None), (2, None, ""),
    (4, "http://a.example/x", "WARC/1.1\r\nWARC-Type: fake\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (6, "http://a.example/é\r\nInjected: 1", "é🙂\x00" * 1000), (7, "x", "y" * 300_000), (None, "http://n.example/", "<p>one</p>"), (3, "https://www.A.example/x/#top", "<p>one</p>"),
]
SCHEMA = "page_id long, url string, html string"


def expected(rows, least=0):
    first = {}
    for i, _, h in rows:
        data = (h or "").encode()
        if i is not None and len(data) >= least:
            first[data] = min(first.get(data, i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = i is not None and len(data) >= least and first[data] != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[data] if again else None))
    return sorted(out, key=str)


def stored(spark, tmp_path, rows, **how):
    stage = Stage(spark, "test-warc")
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA + ", digest string, payload string").repartition(3).select("page_id", "url", "html")
    return W.archive(pages, f"file://{tmp_path}/archive", stage, **how)


@pytest.mark.parametrize("least", [0, 20])
def test_round_trip_and_revisits(spark, tmp_path, least):
    got = stored(spark, tmp_path, ROWS, least_bytes=least)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in collected(got)), key=str) == expected(ROWS, least)


def test_every_index_entry_reads_its_record(spark, tmp_path):
    pages = dict((i, h) for i, _, h in ROWS)
    for r in collected(stored(spark, tmp_path, ROWS)):
        with open(r["run"].removeprefix("file:"), "rb") as f:
            f.seek(r["offset"])
            text = gzip.decompress(f.read(r["length"]))
        assert text.startswith(b"WARC/1.1\r\n") and f"WARC-Type: {r['record_type']}".encode() in text
        if r["record_type"] == "response" and r["page_id"] is not None:
            assert text.endswith(b"\r\n\r\n" + (pages[r["page_id"]] or "").encode() + b"\r\n\r\n")


def test_index_is_ordered_across_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "RANGE_ENTRIES", 40)
    monkeypatch.setattr(W, "FILE_BYTES", 6_000)
    rng = random.Random(1)
    rows = [(i, f"http://h{rng.randrange(5)}.example/{rng.randrange(30)}", f"page {i % 90}") for i in range(300)]
    index = stored(spark, tmp_path, rows)
    assert index.rdd.getNumPartitions() > 3 and len({r["run"] for r in collected(index)}) > 5
    keys = [W.sort_key(r["url_key"], r["captured"], r["page_id"]) for r in collected(index)]
    assert keys == sorted(keys) and len(keys) == 300
    sizes = [p.stat().st_size for p in (tmp_path / "archive").rglob("*.txt")]
    assert len(sizes) > 5 and max(sizes) < 7_000


def test_the_query_returns_the_history_in_order(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(W, "RANGE_ENTRIES", 9)
    rows = collected(W.op2_warc(spark, sf_dir))
    keys = [W.sort_key(r["url_key"], r["captured"], r["page_id"]) for r in rows]
    assert keys == sorted(keys)
    pages = [(r["page_id"], r["url"], r["html"]) for r in collected(spark.read.parquet(f"{sf_dir}/pages.parquet"))]
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=str) == expected(pages)


def test_runs_are_merged_as_they_are(spark):
    entries = [(f"run{r}", n, key, "t", 10 * n + r, "u", "response", None, "D", 1, 0, 1) for r in range(5) for n, key in enumerate(sorted(random.Random(r).choices("abcdef", k=40)))]
    df = spark.createDataFrame(entries, W.ENTRY_SQL).repartition(4)
    got = [(r["url_key"], r["page_id"]) for r in collected(W.merge(df, 6))]
    assert got == sorted((e[2], e[4]) for e in entries)
    wrong = spark.createDataFrame([(*e[:2], "z" if e[1] == 3 else e[2], *e[3:]) for e in entries], W.ENTRY_SQL)
    with pytest.raises(Exception, match="isn't in order"):
        W.merge(wrong, 1).count()


def test_hot_payloads_are_joined_apart(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://h{i}.example", "" if i % 3 else "<p>same</p>" if i % 2 else f"own {i}") for i in range(60)]
    want = expected(rows)
    for hot, most in ((1, 500), (10, 500), (1, 0), (1000, 500)):
        monkeypatch.setattr(W, "HOT_ROWS", hot), monkeypatch.setattr(W, "BROADCAST_ROWS", most)
        got = collected(stored(spark, tmp_path / f"{hot}-{most}", rows))
        assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == want


def test_loser_tree():
    rng = random.Random(2)
    for k in range(20):
        runs = [sorted(rng.choices(range(30), k=rng.randrange(10))) for _ in range(k)]
        assert list(W.LoserTree(runs, lambda x: x)) == sorted(sum(runs, []))


def test_url_keys():
    assert W.url_key("https://www.Sub.Example.com:443/A/b/?z=1&a=2#x") == "com,example,sub)/a/b?a=2&z=1"
    assert W.url_key("") == ")/" and W.url_key("http://user@h.example") == "example,h)/"


def test_a_damaged_archive_is_refused():
    data = W.record(1, "u", b"abc", "D", None)
    assert [x[2]["warc-type"] for x in W.parse(data + W.EMPTY + data)] == ["response"] * 2
    with pytest.raises(ValueError, match="cut off"):
        list(W.parse(data[:-9]))


def test_no_rows(spark, tmp_path):
    assert stored(spark, tmp_path, []).count() == 0


def test_a_page_id_with_several_payloads(spark, tmp_path):
    rows = [(1, "http://a.example", "A"), (2, "http://b.example", "B"), (3, "http://c.example", "A"), (3, "http://d.example", "B"), (3, "http://e.example", "own"), (4, "http://f.example", "own")]
    got = collected(stored(spark, tmp_path, rows))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == expected(rows)
