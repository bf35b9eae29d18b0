"""Queries that take their whole tables, against brute force on small fixtures."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from marginalia.functions.text import STOP_WORDS
from marginalia.operators import neighbours as N
from marginalia.operators import providers as P
from marginalia.plans.catalog import CATALOG


def content(text):
    return {w.lower() for w in re.findall(r"[A-Za-z][A-Za-z'\-]+", text or "")} - set(STOP_WORDS) - {w.lower() for w in re.findall(r"\b[A-Za-z]{2}\b", text or "")}


def components(edges):
    near, out = defaultdict(set), {}
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    for n in sorted(near):
        todo = [] if n in out else [n]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = n
                todo += near[x]
    return out


@pytest.fixture
def small(spark, tmp_path, sf_dir):
    """Documents with ids beyond 400 and words beyond the 60th character; line items of the given tables."""
    rng = random.Random(4)
    words = [f"{a}{b}ing" for a in "pqrstv" for b in ("alo", "emi", "odu")]
    ids = [*range(20), *range(395, 425), *range(9000, 9020)]
    docs = [(i, "the same opening words for all of them, and then nothing " + " ".join(rng.sample(words, rng.randrange(3, 14)) * 2), "src") for i in ids]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path), docs


def test_duplicate_queries_take_all_documents_and_whole_texts(spark, small):
    d, docs = small
    words = {i: content(t) for i, t, _ in docs}
    like = {(a, b): len(words[a] & words[b]) / len(words[a] | words[b]) for a, b in itertools.combinations(sorted(words), 2) if a // 10 == b // 10}
    got = {(r.a, r.b): r.j for r in CATALOG["tag_token_jaccard_pairs"][0](spark, d).collect()}
    assert got == {p: round(j, 6) for p, j in like.items()} and any(j < 0.9 for j in got.values())
    part = components(p for p, j in like.items() if j >= 0.3)
    sub = {(r.cluster, r.card_id): r.sub for r in CATALOG["subclusters"][0](spark, d).collect()}
    assert sub == {(i // 10, i): part.get(i, i) for i in words}
    sizes = Counter(sub.values())
    decided = CATALOG["decision_ladder"][0](spark, d).collect()
    score = {i: round(0.4 + (i * 37 % 23) / 100, 4) for i in words}
    best = {s: min((i for (_, i), t in sub.items() if t == s), key=lambda i: (-score[i], i)) for s in sizes}
    assert {r["sub"]: (r["size"], r["winner_id"]) for r in decided} == {s: (n, best[s]) for s, n in sizes.items()}
    total = CATALOG["dedup_summary"][0](spark, d).first()
    assert (total.coarse_clusters, total.sub_clusters, total.singletons) == (len({i // 10 for i in words}), len(sizes), sum(n == 1 for n in sizes.values()))
    applied = [r["size"] - 1 for r in decided if r["decision"] == "apply"]
    assert (total["apply"], total["cards_to_hide"]) == (len(applied), sum(applied))


def test_clusters_keep_every_one_of_many_equal_vectors(spark, tmp_path):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(700)] + [(1000, [-3.0, 0.0, 1.0]), (1001, [-3.0, 0.1, 1.0]), (1002, [0.0, -1.0, 0.0]), (1003, [0.0, 0.0, 0.0]), (1004, [0.0, 0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.card_id: (r.cluster, r["size"]) for r in CATALOG["dup_clusters_knn"][0](spark, str(tmp_path)).collect()}
    assert got == {i: (0, 700) for i in range(700)} | {1000: (1000, 2), 1001: (1000, 2)}


def test_linking_pairs_connect_what_all_pairs_connect(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(150, 4)).round(3)
    v[100:120] = v[7]
    v[120:140] = v[8] + rng.normal(size=(20, 4)) * 0.01
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    d = 1 - v @ v.T / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1))
    for threshold in (0.005, 0.03):
        want = components((a, b) for a in range(150) for b in range(a) if d[a, b] < threshold)
        for block in (17, 1000):
            pairs = [(r.a, r.b) for r in N.linking_pairs(df, threshold, block=block).collect()]
            assert components(pairs) == want and all(d[p] < threshold for p in pairs)


def test_every_document_has_postings(spark, small):
    d, docs = small
    got = CATALOG["postings"][0](spark, d)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {i for i, _, _ in docs}


def test_limiter_decides_on_the_events_of_all_users(spark, tmp_path):
    rng = random.Random(5)
    start = 1_700_000_000
    events = [(k, rng.randrange(7), start + rng.randrange(200_000)) for k in range(300)]
    spark.createDataFrame(events, "event_id long, user_id long, s long").selectExpr("event_id", "user_id", "timestamp_seconds(s) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    want, log = {}, defaultdict(list)
    for k, user, s in sorted(events, key=lambda e: (e[2], e[0])):
        want[k] = sum(x > s - 43200 for x in log[user]) < 3
        log[user] += [s] * want[k]
    got = CATALOG["sliding_limiter"][0](spark, str(tmp_path)).collect()
    assert {r.id: r.allowed for r in got} == want and len(got) == 300 and len(set(want.values())) == 2


def test_components_take_all_lines(spark, tmp_path):
    rng = random.Random(6)
    lines = [(rng.randrange(40), rng.randrange(60), float(rng.randrange(1, 51))) for _ in range(45)] + [(1_000_007, 7, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.node: r.component for r in CATALOG["components"][0](spark, str(tmp_path)).collect()}
    assert got == components((2 * o, 2 * p + 1) for o, p, _ in lines)


def test_words_late_in_a_text_count(spark, tmp_path):
    docs = [(1, "x " * 400 + "border capital", "src"), (2, "x " * 400, "src")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    tags = {r.doc_id: r.tags for r in CATALOG["infer_tags"][0](spark, str(tmp_path)).collect()}
    tokens = {r.doc_id: r.tokens for r in CATALOG["tag_tokens"][0](spark, str(tmp_path)).collect()}
    assert tags == {1: "cap-k,border", 2: ""} and tokens == {1: "border capital", 2: ""}


def test_equal_spans_of_an_order_merge_into_one(spark, tmp_path):
    """Equal spans, for which the SQL's order leaves open which comes first, after one that ends before them."""
    lines = [(1, 1, 10.0), (1, 20, 30.0), (1, 20, 30.0), (1, 20, 30.0), (1, 80, 10.0), (1, 80, 10.0)]
    spark.createDataFrame([(o, p, k, q, "A") for k, (o, p, q) in enumerate(lines)], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {n: [tuple(r) for r in CATALOG[n][0](spark, str(tmp_path)).select("start", "end").orderBy("start", "end").collect()] for n in ("span_normalize", "span_subtract")}
    assert got == {"span_normalize": [(1, 11), (20, 50), (80, 90)], "span_subtract": [(1, 11), (20, 30), (80, 90)]}
    added = {n: {(r.kind, r.start, r.end) for r in CATALOG[n][0](spark, str(tmp_path)).collect()} for n in ("span_union", "span_add_highlight")}
    held = {("highlight", 1, 11), ("highlight", 20, 50)}
    assert added == {"span_union": held | {("underline", 10, 40), ("highlight", 80, 95)}, "span_add_highlight": held | {("underline", 20, 50), ("highlight", 80, 90)}}


def test_neighbours_of_crowded_and_sparse_tiles(spark, monkeypatch):
    """Blocks of several tiles, one of them with far more near pairs than rows, and a group of equal vectors."""
    from marginalia.operators import tiles

    rng = np.random.default_rng(9)
    v = rng.normal(size=(700, 8)).astype(np.float32)
    v[100:240] = v[7] + 0.001 * rng.normal(size=(140, 8))
    v[300:420] = v[8]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<float>").cache()
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    monkeypatch.setattr(tiles, "CROWDED", 8)
    for x, y, k in ((u, u[:90], 4), (u, u, 6)):
        monkeypatch.setattr(tiles, "TILE", 64)
        r, c, e = tiles.nearest(x, y, k)
        want = np.argsort(np.round(1 - x @ y.T, 9), axis=1, kind="stable")[:, :k]
        assert (c.reshape(-1, k) == want).all() and np.allclose(e, (1 - x @ y.T)[r, c])
    monkeypatch.undo()
    got = {(r.a, r.rn): r.b for r in N.top_k(df, 6).collect()}
    best = np.argsort(np.round(d, 9), axis=1, kind="stable")[:, :6]
    assert got == {(a, n + 1): best[a, n] for a in range(700) for n in range(6)}
    for block in (150, 2048):
        pairs = [(r.a, r.b) for r in N.linking_pairs(df, 0.01, block=block).collect()]
        assert components(pairs) == components(zip(*np.nonzero(d < 0.01))) and len(pairs) < 3000


def test_random_projections_pair_rows_once_and_copies_with_their_first(spark):
    """Before, every shared bucket of two rows was a row of a join: 8 for most of all pairs, and all pairs of 400 copies."""
    rng = np.random.default_rng(12)
    v = rng.normal(size=(900, 8))
    v[500:] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>").cache()
    u = v[:500] / np.linalg.norm(v[:500], axis=1, keepdims=True)
    want = {(a, b) for a, b in zip(*np.nonzero(1 - u @ u.T < 0.2)) if a < b}
    for block in (130, 2048):
        got = [(r.a, r.b) for r in N.lsh_pairs(df, 0.2, block=block).collect()]
        assert len(got) == len(set(got)) and {p for p in got if p[1] >= 500} == {(3, i) for i in range(500, 900)}
        found = {p for p in got if p[1] < 500}
        assert found <= want and len(found) >= 0.9 * len(want) > 100
    plan = N.lsh_pairs(df, 0.2)._jdf.queryExecution().optimizedPlan().toString()
    assert "hashValue" not in plan and "entry" not in plan


def test_copies_are_in_all_their_near_pairs(spark, tmp_path, monkeypatch):
    """Two groups of equal vectors near each other, one of several parts, pairs of copies, and single vectors."""
    from marginalia.operators import vector_index

    monkeypatch.setattr(vector_index, "PART", 4, raising=False)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(90, 6)).astype(np.float32)
    v[10:40:2], v[41:45], v[60:64] = v[7], v[7] + np.float32(0.01), v[[1, 2, 3, 3]]
    v[70:80] = 2 * v[7]  # equal but for their length
    ids = rng.permutation(90) * 3
    spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    d = 1 - u @ u.T
    want = {(min(i, j), max(i, j)): d[x, y] for x, i in enumerate(ids.tolist()) for y, j in enumerate(ids.tolist()) if x < y and d[x, y] < 0.6}
    got = CATALOG["near_pairs_indexed"][0](spark, str(tmp_path)).collect()
    assert {(r.a, r.b) for r in got} == set(want) and len(got) == len(want) > 400
    assert all(abs(r.distance - want[r.a, r.b]) < 2e-6 for r in got)


def test_every_text_with_words_is_embedded(spark, tmp_path):
    """Words whose signed counts cancel out, and white space that the SQL's pattern doesn't take for any."""
    by_place = {}
    for k in range(5000):
        h = zlib.crc32(f"w{k}".encode())
        by_place.setdefault((h % P.DIMENSIONS, h >> 31), f"w{k}")
    place = next(p for p, sign in by_place if (p, 1 - sign) in by_place)
    cancels = f"{by_place[place, 0]} {by_place[place, 1].upper()}"
    docs = [(1, "some words"), (2, cancels), (3, cancels + "\n" + cancels), (4, "\u00a0"), (5, "\x0b\u3000"), (6, " \t\r\n\f"), (7, ""), (8, None), (9, cancels)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, [0.5] * 64)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    query, sql = CATALOG["embed_missing"]
    got = {r.doc_id: r.dimensions for r in query(spark, str(tmp_path)).collect()}
    with duckdb.connect() as db:
        for t in ("documents", "embeddings"):
            db.execute(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet/*.parquet'")
        assert got == dict(db.execute(sql).fetchall()) == {k: 64 if k == 9 else 512 if k < 6 else None for k in range(1, 10)}
    assert all(sum(x * x for x in v) == pytest.approx(1) for v in P.hashed_embedding([t for k, t in docs if k < 6]))
