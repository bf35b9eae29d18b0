"""Stored indexes, interval joins, keyed state, merges by bucket and incremental components."""

import math
import random
from datetime import date, datetime, timedelta
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marginalia.operators import gram_index as G
from marginalia.operators import intervals as I
from marginalia.functions import spans as SP
from marginalia.operators import neighbours as N
from marginalia.operators import providers as P
from marginalia.operators import ranked_index as R
from marginalia.operators import search as S
from marginalia.operators import vector_index as V
from marginalia.plans.components import connected_components, merge_components, updated_components
from marginalia.sources import docx
from marginalia.streaming import limiter, timed
from marginalia.streaming.inbox import Inbox
from marginalia.streaming.touched import BucketedSeen
from tests.test_operators import put  # noqa: F401


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pruned(df, folder):
    """Whether a scan of the plan reads only some folders."""
    return any(f"{folder}#" in part.split("]")[0] for part in plan_of(df).split("PartitionFilters: [")[1:])


# Vectors -------------------------------------------------------------------------------------


def vectors(spark, n=400, seed=1, spots=12):
    """Vectors in spots, of lengths from 0.01 to 100, with copies in other lengths, and some without a direction."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(spots, 16))
    v = centres[rng.integers(0, spots, n)] + 0.4 * rng.normal(size=(n, 16))
    v *= 10 ** rng.uniform(-2, 2, (n, 1))
    data = [(k, x.tolist()) for k, x in enumerate(v)]
    data += [(n + k, (v[k] * 8).tolist()) for k in range(5)] + [(n + 10, [0.0] * 16), (n + 11, None), (n + 12, [math.inf] * 16)]
    return spark.createDataFrame(data, "id long, embedding array<double>").repartition(4)


def test_vector_index_finds_the_neighbours(spark, tmp_path):
    df = vectors(spark).cache()
    index = V.build(df, f"file://{tmp_path}/ix")
    good = df.where("id <= 404 or id < 400")
    want = {(r.a, r.b) for r in N.top_k(good, 8).collect()}
    got = V.search(index, df, 8).collect()
    assert len({r.a for r in got}) == 405 and all(r.a != r.b for r in got)
    assert len({(r.a, r.b) for r in got} & want) >= 0.95 * len(want)
    every = V.search(index, df, 8, probes=len(index.centres))  # all lists: the exact answer
    assert {(r.a, r.rn): r.b for r in every.collect()} == {(r.a, r.rn): r.b for r in N.top_k(good, 8).collect()}


def test_vector_index_on_the_given_vectors(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index = V.build(e, f"file://{tmp_path}/ix", "vec_id")
    want = {(r.a, r.b) for r in N.top_k(e, 8, id_col="vec_id").collect()}
    got = {(r.a, r.b) for r in V.search(index, e, 8, id_col="vec_id").collect()}
    assert len(got) == len(want) and len(got & want) >= 0.95 * len(want)


def test_few_queries_read_few_folders(spark, tmp_path):
    df = vectors(spark)
    index = V.build(df, f"file://{tmp_path}/ix")
    one = df.where("id = 3")
    probed = one.select("id", V.unit(F.col("embedding")).alias("v")).select("id", "v", V._nearest(index.centres, 2)("v").alias("lists"))
    assert pruned(V._dealt(index, probed), "list")
    assert V.search(index, one, 8).count() == 8


def test_a_third_of_all_vectors_in_one_spot_is_split(spark, tmp_path):
    rng = np.random.default_rng(3)
    hot = rng.normal(size=16) + 0.01 * rng.normal(size=(700, 16))
    v = np.vstack([hot, rng.normal(size=(1400, 16))])
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, embedding array<double>")
    index = V.build(df, f"file://{tmp_path}/ix")
    assert max(index.sizes.values()) < 350


def test_pairs_within_are_exact(spark, tmp_path):
    df = vectors(spark).cache()
    index = V.build(df, f"file://{tmp_path}/ix")
    v = {r.id: np.array(r.embedding) for r in df.where("id <= 404").collect()}
    cos = {(a, b): 1 - v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b]) for a in v for b in v if a < b}
    copies = {(k, 400 + k) for k in range(5)}
    want = {p for p, d in cos.items() if d < 0.1 and p[1] < 400} | copies
    got = [(r.a, r.b) for r in V.pairs_within(index, 0.1).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30


def test_empty_and_single_vector_index(spark, tmp_path):
    none = spark.createDataFrame([(1, None)], "id long, embedding array<double>")
    index = V.build(none, f"file://{tmp_path}/a")
    assert V.search(index, none).collect() == [] and V.pairs_within(index, 0.5).collect() == []
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [3.0, 0.0])], "id long, embedding array<double>")
    index = V.build(one, f"file://{tmp_path}/b")
    assert rows(V.search(index, one, 1)) == [(1, 2, 0.0, 1), (2, 1, 0.0, 1), (3, 1, 0.0, 1)]


def test_lsh_pairs_of_any_length(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [50.0, 1.0, 0.0]), (3, [0.01, 0.0, 0.0003]), (4, [0.0, 3.0, 0.0]), (5, [0.0, 0.0, 0.0])], "id long, embedding array<double>")
    assert {(r.a, r.b) for r in N.lsh_pairs(df, 0.1, bucket=4.0).collect()} == {(1, 2), (1, 3), (2, 3)}


# Substrings ----------------------------------------------------------------------------------


def test_pieces_of_a_pattern():
    assert G.pieces(r"ab%c_de\%f\\g%%") == ["ab", "c", "de%f\\g"] and G.pieces("%_%") == [] and G.pieces("") == []


@pytest.mark.parametrize("pattern", ["street", "RÉSUMÉ", "a_c", "e%T", "st_ee%x", "ab", "", "%", r"100\%", "no such piece", "ΟΔΟΣ", "🙂🙃x", "tre"])
def test_gram_index_equals_ilike(spark, tmp_path, pattern):
    texts = ["Street art", "A résumé, my Résumé", "aXc abc", "the sTreeT axe", "100% sure", "1000 sure", None, "", "st", "οδος Οδός", "🙂🙃xx", "streetstreet x", "a%c"]
    df = spark.createDataFrame([(k, t, texts[-k - 1]) for k, t in enumerate(texts)] + [(99, "Street art", None)] * 2, "id long, one string, two string")
    index = G.build(df, f"file://{tmp_path}/ix", "id", ["one", "two"])
    like = f"%{pattern}%"
    want = df.where(F.coalesce(F.ilike("one", F.lit(like)), F.lit(False)) | F.coalesce(F.ilike("two", F.lit(like)), F.lit(False)))
    assert rows(G.matching(df, index, pattern, "id")) == rows(want)


def test_gram_index_reads_only_its_folders(spark, sf_dir, tmp_path):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    index = G.build(part, f"file://{tmp_path}/ix", "p_partkey", ["p_name", "p_type"])
    wanted = index.grams_of("widget")
    assert 0 < len(wanted) <= G.LOOKED_UP and index.grams_of("%ab_c%") == []
    found = index.candidates(wanted)
    assert pruned(found, "folder")
    assert found.count() and len(index._read("postings", wanted).select("folder").distinct().collect()) <= len(wanted) < index.folders


# Ranked search -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ranked(spark, tmp_path_factory):
    rng = random.Random(5)
    words = ["run", "running", "cat", "the", "dog", "zebra", *(f"w{k}" for k in range(40))]
    docs = [(k, rng.choice(["alpha run", "beta", "cat tale", None]), " ".join(rng.choice(words) for _ in range(rng.choice([3, 10, 60, 400])))) for k in range(3000)]
    df = spark.createDataFrame([*docs, (5000, None, ""), (5001, "", None)], "doc_id long, source string, text string").cache()
    path = f"file://{tmp_path_factory.mktemp('ranked')}"
    fields = {"source": "A", "text": "B"}
    return df, R.save(df, f"{path}/plain", "doc_id", fields), R.save(df, f"{path}/english", "doc_id", fields, "english"), fields


@pytest.mark.parametrize("text", ["run", "cat dog", "zebra or alpha", '"cat tale"', "w1 w2 w3 w4", "run -cat", "nothing", "the"])
@pytest.mark.parametrize("language", [None, "english"])
def test_early_stop_gives_the_rows_of_the_full_ranking(ranked, text, language):
    df, plain, english, fields = ranked
    if language and text == "the":  # a stop word alone asks for nothing
        with pytest.raises(ValueError):
            R.top(english, text)
        return
    full = S.evaluate(S.postings(df, "doc_id", fields, language), S.parse_query(text, language)).where("by_words").withColumn("rank", F.round("rank", R.DIGITS))
    want = [(r.doc_id, r["rank"]) for r in full.orderBy(F.desc("rank"), F.desc("doc_id")).limit(20).collect()]
    assert [(r.doc_id, r["rank"]) for r in R.top(english if language else plain, text).collect()] == want


def test_blocks_are_skipped(ranked):
    df, plain, _, _ = ranked
    first, others, threshold = R.blocks_read(plain, "zebra", 20)
    every = plain.blocks(S.parse_query("zebra")).count()
    assert threshold is not None and len(first) + others.count() < every


def test_ranked_postings_are_read_by_folder(ranked):
    found = ranked[1].postings(S.parse_query("zebra"))
    assert pruned(found, "bucket") and "EqualTo(term,zebra)" in plan_of(found).split("PushedFilters: ")[1]


# Intervals -----------------------------------------------------------------------------------


def spans(seed, n):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        start = rng.choice([rng.randrange(-200, 200), rng.randrange(-(2**40), 2**40)])
        out.append((rng.choice(["x", "y", None]), start, start + rng.choice([0, 1, 2, 7, 8, 9, 64, 65, 500, 2**35, -3]), k))
    return [*out, ("x", None, 5, n), ("x", 1, None, n + 1), ("x", -5, 5, n + 2), ("x", -5, 5, n + 3)]


@pytest.mark.parametrize("seed", range(3))
def test_interval_joins_equal_nested_loops(spark, seed):
    a, b = spans(seed, 150), spans(seed + 50, 150)
    left, right = (spark.createDataFrame(x, "key string, start long, end long, n long") for x in (a, b))
    ok = [(p, q) for p in a for q in b if None not in (*p[:3], *q[:3]) and p[0] == q[0] and p[1] < p[2] and q[1] < q[2]]
    inside = sorted((p[3], q[3]) for p, q in ok if q[1] <= p[1] and p[2] <= q[2])
    shared = sorted((p[3], q[3], max(p[1], q[1]) - q[1], min(p[2], q[2]) - q[1]) for p, q in ok if p[1] < q[2] and q[1] < p[2])
    assert sorted((r.n_a, r.n_b) for r in I.contained(left, right).collect()) == inside
    assert sorted((r.n_a, r.n_b, r.clip_start, r.clip_end) for r in I.clipped(left, right).collect()) == shared and len(shared) > 50


def test_long_intervals_stay_few_rows(spark):
    long = spark.createDataFrame([("x", k, k + 10**9, k) for k in range(50)], "key string, start long, end long, n long")
    short = spark.createDataFrame([("x", k, k + 1, k) for k in range(50)], "key string, start long, end long, n long")
    a = I._named(long, ("key", "start", "end"), "a")
    assert I._placed(a, "a", F.array("_w_a")).count() <= 100
    joined = I.overlapping(short, long)
    assert joined.count() == sum(k >= m for k in range(50) for m in range(50))
    assert "NestedLoop" not in plan_of(joined) and "Cartesian" not in plan_of(joined)


def test_empty_intervals(spark):
    none = spark.createDataFrame([], "key string, start long, end long")
    assert I.contained(none, none).collect() == [] and I.clipped(none, none).collect() == []


# Keyed state ---------------------------------------------------------------------------------


def run(spark, events, tmp_path, windows, files, late="10 minutes", idle=60.0):
    """The limited stream of ``events`` (id, key, ts) dealt into files in this order; rows, and the query."""
    for part in files:
        spark.createDataFrame([events[k] for k in part], "id long, key string, ts timestamp").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("id long, key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    with timed.rocksdb(spark):
        q = timed.limit_timed(stream, windows, "key", "ts", "id", late, idle).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return spark.read.parquet(f"file://{tmp_path}/out"), q


def test_keyed_state_equals_the_batch(spark, tmp_path):
    rng, t0 = random.Random(2), datetime(2024, 1, 1)
    events = sorted(((k, rng.choice("abc"), t0 + timedelta(seconds=rng.randrange(900))) for k in range(150)), key=lambda e: (e[2], e[0]))
    windows = (limiter.Window(3, 35.0), limiter.Window(10, 200.0))
    got, _ = run(spark, events, tmp_path, windows, [range(0, 50), range(50, 90), range(90, 150)])
    want = limiter.limit_batch(spark.createDataFrame(events, "id long, key string, ts timestamp"), windows, "key", "ts", "id")
    shown = lambda df: sorted((r.id, r.allowed, round(r.retry, 6)) for r in df.collect())
    assert shown(got) == shown(want) and not all(r.allowed for r in got.collect())


def test_idle_keys_leave_the_state(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    events = [(0, "idle", t0), (1, "busy", t0), (2, "busy", t0 + timedelta(hours=1)), (3, "busy", t0 + timedelta(hours=2)), (4, "busy", t0 + timedelta(hours=3))]
    got, q = run(spark, events, tmp_path, (limiter.Window(2, 30.0),), [[0, 1], [2], [3], [4]], late="1 minute", idle=60.0)
    assert got.count() == 5
    removed = sum(op["numRowsRemoved"] for p in q.recentProgress for op in p["stateOperators"])
    custom = [p["stateOperators"][0]["customMetrics"] for p in q.recentProgress if p["stateOperators"]]
    fired = sum(m.get("numExpiredTimers", 0) for m in custom)
    assert removed or fired, custom[-1]


class Held:
    """What a processor asks of its handle and of the watermark, held in memory."""

    def __init__(self):
        self.rows, self.timers, self.watermark = [], [], 0

    def getListState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        return iter(list(self.rows))

    def put(self, rows):
        self.rows = rows

    def clear(self):
        self.rows = []

    def listTimers(self):  # noqa: N802
        return [(t,) for t in self.timers]

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.watermark


def test_one_call_takes_many_keys_and_forgets_the_old_ones():
    rng, held = random.Random(7), Held()
    processor, window = timed.Limiter((limiter.Window(2, 30.0),), 5.0), (limiter.Window(2, 30.0),)
    processor.init(held)
    logs, n = {}, 0
    for batch in range(4):
        lo = 100 * batch
        rows = pd.DataFrame([(n + i, rng.choice([*map(str, range(40)), None]), float(lo + rng.randrange(100))) for i in range(300)], columns=["id", "key", "ts"])
        n += 300
        held.watermark = lo * 1000
        got = pd.concat(processor.handleInputRows((3,), iter([rows[:200], rows[200:]]), held))
        want = {r.id: logs.setdefault(r.key, limiter.Log(window)).hit(r.ts) for r in rows.sort_values(["ts", "id"]).itertuples()}
        assert {r.id: (r.allowed, r.retry) for r in got.itertuples()} == want
        assert held.timers == [int((max(t for _, t in held.rows) + 35) * 1000)] and all(t + 35 > lo for _, t in held.rows)
    assert not list(processor.handleExpiredTimer((3,), held, None))[0].size and not held.rows


def test_buckets_grow_with_a_batch():
    assert timed.buckets_for(0) == 64 and timed.buckets_for(12_000_000) * timed.BUCKET_EVENTS >= 12_000_000


# Merges --------------------------------------------------------------------------------------


def files_of(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_a_merge_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    table = BucketedSeen(spark, f"file://{tmp_path}/t", f"file://{tmp_path}/s", buckets=8)
    day = lambda n: date(2024, 1, n)
    frame = lambda data: spark.createDataFrame(data, "file_sha256 string, seen date")
    assert table.read().count() == 0 and table.merge(frame([])) == []
    table.merge(frame([(f"h{k}", day(10)) for k in range(100)] + [(None, day(1))]))
    before = files_of(tmp_path / "t")
    touched = table.merge(frame([("h1", day(5)), ("h2", day(20)), ("new", day(7)), ("h1", day(6))]))
    after = files_of(tmp_path / "t")
    assert {k: v for k, v in before.items() if int(k.split("=")[1].split("/")[0]) not in touched} == {k: v for k, v in after.items() if int(k.split("=")[1].split("/")[0]) not in touched}
    assert 0 < len(touched) <= 3 and not any(k in after for k in before if int(k.split("=")[1].split("/")[0]) in touched)
    got = {r.file_sha256: (r.first_seen, r.last_seen) for r in table.read().collect()}
    assert len(got) == 101 and got["h1"] == (day(5), day(10)) and got["h2"] == (day(10), day(20)) and got["new"] == (day(7), day(7)) and got["h3"] == (day(10), day(10))
    same = rows(table.read())
    table.merge(frame([("h1", day(5)), ("h2", day(20))]))  # the same batch again
    assert rows(table.read()) == same


def test_a_failed_batch_leaves_the_table(spark, tmp_path):
    table = BucketedSeen(spark, f"file://{tmp_path}/t", f"file://{tmp_path}/s", buckets=4)
    table.merge(spark.createDataFrame([("a", date(2024, 1, 1))], "file_sha256 string, seen date"))
    before, same = files_of(tmp_path / "t"), rows(table.read())
    bad = spark.createDataFrame([("a", "x")], "file_sha256 string, text string").select("file_sha256", F.raise_error(F.lit("broken")).cast("date").alias("seen"))
    with pytest.raises(Exception, match="broken"):
        table.merge(bad)
    assert files_of(tmp_path / "t") == before and rows(table.read()) == same


# Samples -------------------------------------------------------------------------------------


@pytest.mark.parametrize("margin", [6, -100])
def test_stratified_samples(spark, monkeypatch, margin):
    """Also when the bound lets nothing through, and every stratum is ranked whole."""
    import hashlib

    monkeypatch.setattr(P, "MARGIN", margin)
    rng = random.Random(1)
    data = [(k, rng.choice(["hot"] * 20 + ["a", "b", None])) for k in range(3000)] + [(9000 + k, "three") for k in range(3)] + [(7, "same")] * 9
    df = spark.createDataFrame(data, "id long, s string").repartition(3)
    key = lambda i: (hashlib.md5(f"{i}:4".encode()).hexdigest(), i)
    want = []
    for s in {x for _, x in data}:
        ids = sorted((i for i, x in data if x == s), key=key)
        want += [(i, s, len(ids), n) for n, i in enumerate(ids[:6], 1)]
    assert rows(P.stratified(df, ["s"], 6, "id", 4)) == sorted(want, key=str)
    assert P.stratified(df.limit(0), ["s"], 6, "id").collect() == []


# Inbox ---------------------------------------------------------------------------------------


def word_file(spark, texts):
    """The bytes of a Word file with a card for each text."""
    none = F.lit(None).cast("string")
    heads = F.array(F.struct(F.lit(1).alias("level"), F.lit("AFF").alias("heading")), F.struct(F.lit(4).alias("level"), F.col("tag").alias("heading")))
    given = spark.createDataFrame([(1, k, f"claim {k}", t) for k, t in enumerate(texts, 1)], "workspace long, position int, tag string, card_text string")
    made = given.select("workspace", "position", heads.alias("headings"), none.alias("tag"), F.array().cast(SP.SPANS).alias("tag_markup"), F.lit("Smith 22").alias("cite_short"), none.alias("raw_cite"), "card_text", none.alias("argument"), none.alias("answer_to"), F.array().cast(SP.SPANS).alias("markup"))
    return bytes(docx.export_lists(made).first()["content"])


def test_inbox_stores_each_file_once_and_moves_it(spark, tmp_path, monkeypatch):
    root, done = tmp_path / "in", tmp_path / "done"
    for folder in ("2024/a b", "garbage", "."):
        (root / folder).mkdir(parents=True, exist_ok=True)
    (root / "2024/a b/one.docx").write_bytes(word_file(spark, ["first body", "second body"]))
    (root / "two.DOCX").write_bytes(word_file(spark, ["third body"]))
    (root / "bad.docx").write_bytes(b"no document")
    (root / "empty.docx").write_bytes(word_file(spark, [" "]))
    (root / "garbage/three.docx").write_bytes(word_file(spark, ["never"]))
    inbox = Inbox(spark, f"file://{root}", f"file://{done}", f"file://{tmp_path}/table")
    real, calls = Inbox.move, []

    def broken(self, path):
        calls.append(path)
        if len(calls) == 2:
            raise OSError("power cut")
        real(self, path)

    monkeypatch.setattr(Inbox, "move", broken)
    with pytest.raises(Exception, match="power cut"):
        inbox.start().awaitTermination()
    assert len([p for p in done.rglob("*") if p.is_file()]) == 1  # cut off between two moves
    monkeypatch.setattr(Inbox, "move", real)
    (root / "late.docx").write_bytes(word_file(spark, ["late body"]))
    inbox.start().awaitTermination()  # takes the batch up again, then the new file
    inbox.start().awaitTermination()  # nothing new
    moved = sorted(str(p.relative_to(done)) for p in done.rglob("*") if p.is_file() and not p.name.startswith("."))
    assert moved == ["2024/a b/one.docx", "late.docx", "two.DOCX"]
    assert sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file() and not p.name.startswith(".")) == ["bad.docx", "empty.docx", "garbage/three.docx"]
    assert sorted(r.card_text for r in inbox.items().collect()) == ["first body", "late body", "second body", "third body"]
    left = {r.path.rsplit("/", 1)[1]: r.error for r in inbox.left().collect()}
    assert set(left) == {"bad.docx", "empty.docx"} and left["bad.docx"].startswith("BadZipFile") and left["empty.docx"] == "no items"


# Components ----------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(2))
def test_components_kept_up_to_date(spark, put, seed):  # noqa: F811
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(240)] + [(7, 7), (None, 3)]
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    cuts = [edges[:80], edges[80:160], edges[160:]]
    labels = put(connected_components(frame(cuts[0]), put), "labels")
    for part in cuts[1:]:
        changed = put(merge_components(labels, frame(part), put), "changed")
        old = {r.node: r.component for r in labels.collect()}
        assert all(old.get(r.node) != r.component for r in changed.collect())  # nothing else is rewritten
        labels = put(updated_components(labels, changed), "labels")
    assert rows(labels) == rows(connected_components(frame(edges), put))


def test_every_posting_takes_no_shuffle_of_words(spark, monkeypatch):
    """Equal to the shuffled postings, also for ids of several rows and of none, and with nothing but ids dealt out."""
    docs = [(1, "a b", "one two one"), (2, None, ""), (3, "", "x"), (4, "B b", "two Zwölf two two"), (4, "b c", "two"), (None, "n", "m m"), (None, "n", None), (5, "same", "same same")]
    docs += [(k, "src", " ".join(f"w{j * k % 23}" for j in range(k))) for k in range(10, 60)]
    df = spark.createDataFrame(docs, "doc_id long, a string, b string").repartition(3).cache()
    monkeypatch.setattr(S, "ROWS", 5)
    for fields in ({"a": "A", "b": "B"}, {"b": "A"}):
        for language in (None, "english"):
            got, want = S.every_posting(df, "doc_id", fields, language), S.postings(df, "doc_id", fields, language)
            assert sorted(map(str, rows(got.drop("longest")))) == sorted(map(str, rows(want)))
    longest = {r.doc_id: r.longest for r in S.every_posting(df, "doc_id", {"a": "A", "b": "B"}).collect()}
    assert longest[1] == 3 and longest[4] == 4 and longest[59] == 59
    once = S.every_posting(df.where("doc_id <> 4"), "doc_id", {"a": "A", "b": "B"})
    assert "Repartition" not in (plan := once._jdf.queryExecution().optimizedPlan().toString()) and "Aggregate" not in plan and "Generate" not in plan


def test_component_tasks_hold_a_bounded_number_of_edges(spark, put, monkeypatch):
    """Before, the session's number of partitions held for any number of edges."""
    from marginalia.plans import components as C

    monkeypatch.setattr(C, "TASK_EDGES", 50)
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before, seen = [spark.conf.get(n) for n in names], []

    def kept(df, name):
        seen.append(int(spark.conf.get(names[0])))
        return put(df, name)

    edges = spark.range(1000).select((F.col("id") * 2).alias("a"), ((F.col("id") * 37) % 500 * 2 + 1).alias("b"))
    found = {r.node: r.component for r in connected_components(edges, kept).collect()}
    assert len(found) == 1500 and found[2] == 2 and found[75] == min(k * 2 for k in range(1000) if k * 37 % 500 == 37)
    assert max(seen) == 40 and [spark.conf.get(n) for n in names] == before
