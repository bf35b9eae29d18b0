"""Word files, reports, snapshots and the limiter, over batches and streams."""

import io
import json
import random
import zipfile
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marginalia.functions.spans import SPANS
from marginalia.operators import ingest
from marginalia.operators import lists as L
from marginalia.operators import segment as G
from marginalia.sources import docx, reports
from marginalia.sources.store import Versions
from marginalia.streaming import limiter, snapshots

NS = f'xmlns:w="{docx.W[1:-1]}"'


def word_file(body, styles=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        if styles is not None:
            z.writestr("word/styles.xml", f"<w:styles {NS}>{styles}</w:styles>")
    return out.getvalue()


def run(text, marks=""):
    return f'<w:r><w:rPr>{marks}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'


def test_runs_and_inheritance():
    styles = '<w:style w:type="character" w:styleId="U"><w:name w:val="u"/><w:rPr><w:u w:val="single"/><w:shd w:fill="FFFF00"/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="H4"><w:name w:val="heading 4"/><w:rPr><w:u w:val="single"/></w:rPr></w:style>'
    body = f"""<w:p><w:pPr><w:pStyle w:val="H4"/></w:pPr>{run("Tag")}</w:p><w:p/><w:p>{run("a", '<w:rStyle w:val="U"/>')}{run("b", '<w:rStyle w:val="U"/><w:u w:val="none"/>')}{run("c", '<w:highlight w:val="yellow"/><w:b/><w:i w:val="0"/><w:sz w:val="23"/>')}{run("d", '<w:highlight w:val="none"/><w:shd w:fill="auto"/>')}{run("")}</w:p>"""
    got = docx.parse_docx(word_file(body, styles))
    assert [(p["idx"], p["style"], p["text"], len(p["runs"])) for p in got] == [(0, "Heading 4", "Tag", 1), (1, "Normal", "", 0), (2, "Normal", "abcd", 4)]
    a, b, c, d = got[2]["runs"]
    assert (a["underline"], a["shading"], a["style"]) == ("single", "FFFF00", "U") and b["underline"] is None and b["shading"] == "FFFF00"
    assert (c["highlight"], c["bold"], c["italic"], c["font_size_pt"]) == ("yellow", True, False, 11.5) and d["highlight"] is None and d["shading"] is None
    assert got[0]["runs"][0]["underline"] is None  # paragraph styles aren't inherited
    assert docx.parse_docx(b"no zip") == [] and len(docx.parse_docx(word_file(body, None))) == 3


def test_folders_of_files(spark, tmp_path):
    data = word_file(f"<w:p>{run('x')}</w:p>")
    for name in ("a.docx", "sub/b.docx", "sub/garbage/c.docx", "skip me.docx", "d.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = docx.read_files(spark, f"file://{tmp_path}", skip_names=("skip me.docx",))
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    assert names(files) == ["a.docx", "b.docx"]
    known = spark.createDataFrame([("a.docx",)], "source_file string")
    assert names(docx.new_files(files, known, known.limit(0))) == ["b.docx"]
    assert [tuple(r) for r in docx.style_summary(docx.paragraphs(files)).collect()] == [("Normal", 2)]
    hashed = snapshots.hashed_files(files).collect()
    assert len({r.file_sha256 for r in hashed}) == 1 and hashed[0].bytes == len(data)
    rows = spark.createDataFrame([("a.docx", 1), ("b.docx", 2)], "source_file string, n int")
    fresh = spark.createDataFrame([("a.docx", 9)], "source_file string, n int")
    assert sorted(tuple(r) for r in docx.reingest(rows, fresh, fresh).collect()) == [("a.docx", 9), ("b.docx", 2)]


def test_export_reads_back(spark):
    u = lambda a, b, k: {"start": a, "end": b, "kind": k}
    schema = f"workspace long, position int, path array<string>, tag string, tag_markup {SPANS}, cite_short string, raw_cite string, card_text string, argument string, answer_to string, markup {SPANS}"
    entries = spark.createDataFrame(
        [(1, 1, ["A", "B"], "Tag <1>", [], "Smith 22", "Smith 22 raw", "one two three", None, None, [u(0, 13, "underline"), u(4, 7, "highlight")]), (1, 2, ["A", "C"], None, None, None, None, None, "our answer", "their claim", [u(0, 3, "highlight")]), (1, 3, ["A", "C"], "T", None, "L 1", None, "", None, None, None)], schema)
    heads = L.new_headings(entries, "workspace", "position", "path").groupBy("workspace", "position").agg(F.array_sort(F.collect_list(F.struct("level", "heading"))).alias("headings"))
    files = docx.export_lists(entries.join(heads, ["workspace", "position"], "left").drop("path")).select(F.col("workspace").cast("string").alias("path"), "content")
    paras = docx.paragraphs(files).orderBy("idx").collect()
    assert [(p.style, p.text) for p in paras] == [("Heading 1", "A"), ("Heading 2", "B"), ("Normal", "Tag <1>"), ("Normal", "Smith 22"), ("Normal", "Smith 22 raw"), ("Normal", "one two three"), ("Heading 2", "C"), ("Normal", "AT: their claim"), ("Normal", "our answer"), ("Normal", "T"), ("Normal", "L 1"), ("Normal", "")]
    spans = {p.idx: [tuple(s) for s in p.m] for p in docx.paragraphs(files).select("idx", G.join_touching(G.run_spans(F.col("runs"), F.lit(0))).alias("m")).collect()}
    assert spans[5] == [(0, 13, "underline"), (4, 7, "highlight")] and spans[8] == [(0, 3, "underline"), (0, 3, "highlight")]
    assert all(r.bold for r in paras[2].runs)


def heading(text, level):
    return f'<w:p><w:pPr><w:pStyle w:val="H{level}"/></w:pPr>{run(text)}</w:p>'


HEADS = "".join(f'<w:style w:type="paragraph" w:styleId="H{k}"><w:name w:val="heading {k}"/></w:style>' for k in range(1, 5))


def test_a_folder_is_ingested_with_its_errors(spark, tmp_path):
    light, line = '<w:highlight w:val="yellow"/>', '<w:u w:val="single"/>'
    body = (
        heading("The Negative", 1) + heading("AT: Growth", 2) + heading("Growth is bad", 4) + "<w:p/>" + f'<w:p>{run("Smith and Jones 22, a title, https://x.org/a.")}</w:p>'
        + f'<w:p>{run("It ")}{run("kills", line)}{run(" us", line + light)}</w:p><w:p/><w:p>{run("all.")}</w:p>'
        + heading("No body here", 4) + f'<w:p>{run("Lee 21")}</w:p>' + heading("An argument", 4) + heading("Next", 3) + heading("Last tag", 4) + f'<w:p>{run("Lee 21")}</w:p><w:p>{run("words")}</w:p>'
    )
    folder = tmp_path / "in" / "sub"
    folder.mkdir(parents=True)
    (folder / "Case.DOCX").write_bytes(word_file(body, HEADS))
    (folder / "empty.docx").write_bytes(word_file("<w:p/>", HEADS))
    (folder / "broken.docx").write_bytes(b"no zip")
    files = docx.read_files(spark, f"file://{tmp_path}/in")
    got = ingest.extract(files, (("growth", ("growth",)), ("none", ("zzz",))))
    assert [r.path.rpartition("/")[2] for r in got.errors.collect()] == ["broken.docx"] and "BadZipFile" in got.errors.first().error
    first, argument, last = got.items.orderBy("tag_idx").collect()
    assert (first.kind, first.tag, first.card_text, first.block_path, first.tags) == ("card", "Growth is bad", "It kills us all.", ["Neg", "AT: Growth"], ["growth", "da-defense"])
    assert [tuple(m) for m in first.markup] == [(3, 11, "underline"), (8, 11, "highlight")] and first.source.cite_short == "Smith and Jones 22" and first.source.url == "https://x.org/a"
    assert (argument.kind, argument.tag, argument.answer_to, argument.card_text, argument.source) == ("analytical", "An argument", "AT: Growth", None, None)
    assert (last.tag, last.card_text, last.block_path) == ("Last tag", "words", ["Neg", "AT: Growth"])  # "Next" went with the argument
    old = spark.createDataFrame([(4, "Lee 21", "Lee 21")], "source_id long, cite_short string, raw_cite string")
    made = ingest.insert(got.items, old, top_card=10, topic_id=2, upload_id=5, status="proposed", now=F.lit("2024-03-01").cast("timestamp"))
    assert [(r.card_id, r.source_id, r.tag, r.topic_id, r.wiki_upload_id, str(r.created_at)) for r in made.cards.orderBy("card_id").collect()] == [(11, 5, "Growth is bad", 2, 5, "2024-03-01 00:00:00"), (12, 4, "Last tag", 2, 5, "2024-03-01 00:00:00")]
    assert {r.source_id for r in made.sources.collect()} == {4, 5} and [r.argument for r in made.analyticals.collect()] == ["An argument"]
    assert sorted((r.card_id or 0, r.analytical_id or 0, r.slug, r.status) for r in made.links.collect()) == [(c, a, s, "proposed") for c, a in ((0, 1), (11, 0), (12, 0)) for s in ("da-defense", "growth")]
    plan = {r.path.rpartition("/")[2]: (r.state, r.target) for r in docx.manifest(files, got.items, f"file:{tmp_path}/in", "/done").collect()}
    assert plan == {"Case.DOCX": ("parsed", "/done/sub/Case.DOCX"), "empty.docx": ("left", None), "broken.docx": ("left", None)}


def test_paragraphs_as_json_lines(spark):
    files = spark.createDataFrame([("f", word_file(f'{heading("T", 4)}<w:p>{run("a", "<w:b/>")}</w:p>', HEADS))], "path string, content binary")
    lines = [json.loads(x) for x in docx.as_jsonl(docx.paragraphs(files)).first().jsonl.split("\n")]
    assert [(x["index"], x["style"], x["text"]) for x in lines] == [(0, "Heading 4", "T"), (1, "Normal", "a")]
    assert lines[1]["runs"][0]["bold"] is True and lines[1]["runs"][0]["highlight"] is None


def test_reports(spark, tmp_path):
    plan = spark.createDataFrame([(1, [1, 2], {"a": "b"})], "winner long, losers array<long>, why map<string,string>")
    reports.save(plan, f"file://{tmp_path}/plan")
    assert reports.load(spark, f"file://{tmp_path}/plan", "winner long, losers array<long>, why map<string,string>").collect() == plan.collect()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        reports.save(plan, f"file://{tmp_path}/plan")
    old = spark.createDataFrame([(1, "a")], "id int, v string")
    new = spark.createDataFrame([(1, "z"), (2, "b"), (2, "b")], "id int, v string")
    once = reports.seed(old, new, ["id"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "b")] and reports.seed(once, new, ["id"]).count() == 2
    assert [r.v for r in reports.backfill(spark.createDataFrame([(None,), ("x",)], "v string"), "v", "d").collect()] == ["d", "x"]


def plain_limiter(times, limit, period):
    kept, out = [], []
    for t in times:
        kept = [k for k in kept if k > t - period]
        ok = len(kept) < limit or kept[0] + period - t <= 0
        out.append((ok, 0.0 if len(kept) < limit else kept[0] + period - t))
        if len(kept) < limit:
            kept.append(t)
    return out


def test_limiter_over_a_batch(spark):
    rng = random.Random(5)
    rows = [(i, f"k{rng.randrange(4)}", rng.randrange(0, 4000) / 4) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, key string, s double").select("id", "key", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"))
    got = {r.id: (r.allowed, r.retry) for r in limiter.limit_batch(df, (limiter.Window(3, 60.0),), "key", "ts", "id").collect()}
    for k in {r[1] for r in rows}:
        mine = sorted((s, i) for i, key, s in rows if key == k)
        assert [got[i] for _, i in mine] == plain_limiter([s for s, _ in mine], 3, 60.0)


def test_every_window_is_charged():
    log = limiter.Log((limiter.Window(1, 10.0), limiter.Window(2, 100.0)))
    assert [log.hit(t) for t in (0.0, 5.0, 10.0, 20.0)] == [(True, 0.0), (False, 5.0), (False, 90.0), (False, 80.0)]
    assert limiter.Log((limiter.Window(1, 10.0),)).hit(0.0) == (True, 0.0)


def test_limiter_keys(spark):
    df = spark.createDataFrame([("search", 7, "1.1.1.1"), ("search", None, "1.1.1.1"), ("login", 7, "1.1.1.1")], "e string, u long, ip string")
    assert [r[0] for r in df.select(limiter.limiter_key(F.col("e"), F.col("u"), F.col("ip"))).collect()] == ["user:7", "ip:1.1.1.1", "ip:1.1.1.1"]


def test_limiter_over_a_stream(spark, tmp_path):
    rows = [(i, "k", datetime(2024, 1, 1) + timedelta(seconds=10 * i)) for i in range(12)]
    for part in range(3):
        spark.createDataFrame(rows[4 * part : 4 * part + 4], "id long, key string, ts timestamp").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("id long, key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = limiter.limit_stream(stream, (limiter.Window(2, 35.0),), "key", "ts", "id").writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    got = {r.id: r.allowed for r in spark.table("limited").collect()}
    batch = {r.id: r.allowed for r in limiter.limit_batch(spark.createDataFrame(rows, "id long, key string, ts timestamp"), (limiter.Window(2, 35.0),), "key", "ts", "id").collect()}
    assert len(got) == 12 and got == batch


def test_snapshots_of_a_file_stream(spark, tmp_path):
    for k, rows in enumerate([[("h1", date(2024, 2, 1)), ("h2", date(2024, 2, 1))], [("h1", date(2024, 1, 1)), ("h3", date(2024, 3, 1))]]):
        spark.createDataFrame(rows, "file_sha256 string, seen date").coalesce(1).write.parquet(f"file://{tmp_path}/in/p{k}")
    table = snapshots.SnapshotTable(spark, f"file://{tmp_path}/table")
    assert table.read().count() == 0
    stream = spark.readStream.schema("file_sha256 string, seen date").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
    q = stream.writeStream.foreachBatch(table.merge).option("checkpointLocation", f"file://{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(map(tuple, table.read().collect())) == [("h1", date(2024, 1, 1), date(2024, 2, 1)), ("h2", date(2024, 2, 1), date(2024, 2, 1)), ("h3", date(2024, 3, 1), date(2024, 3, 1))]
    before = sorted(map(tuple, table.read().collect()))
    table.merge(spark.createDataFrame([("h1", date(2024, 1, 1))], "file_sha256 string, seen date"))
    assert sorted(map(tuple, table.read().collect())) == before


@pytest.mark.parametrize("path,want", [("file:/x/2024-02-03/a.docx", date(2024, 2, 3)), ("/dump_2024-01-05_all/y.docx", date(2024, 1, 5)), ("/none/y.docx", date(2020, 1, 1)), ("/2024-13-45/y", date(2020, 1, 1))])
def test_snapshot_dates(spark, path, want):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(snapshots.snapshot_date(F.col("p"), F.lit(date(2020, 1, 1)))).first()[0] == want


def test_commits_are_whole_or_nothing(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/t", "a long, b string")
    assert store.read().count() == 0 and store.version() is None
    store.commit(spark.createDataFrame([(1, "x")], "a long, b string"))
    store.commit(store.read().unionByName(spark.createDataFrame([(2, "y")], "a long, b string")))
    assert sorted(map(tuple, store.read().collect())) == [(1, "x"), (2, "y")]
    before = store.version()
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        store.commit(store.read().withColumn("a", (F.col("a") / (F.col("a") - 2)).cast("long")))
    assert store.version() == before and Versions(spark, f"file://{tmp_path}/t", "a long, b string").read().count() == 2


def test_dumps_are_probed(spark):
    def probe(url):
        if url.endswith("03-03"):
            raise OSError("no route")
        return 200 if url.endswith(("03-02", "03-03", "02-26")) else 404

    days = snapshots.dump_dates(spark, "2024-03-04", 1)
    got = {str(r.day): r.found for r in snapshots.found_dumps(days, "https://dumps.example/{day}", probe).collect()}
    assert len(got) == 8 and {d for d, f in got.items() if f} == {"2024-03-02", "2024-02-26"}


def test_batches_to_and_from_python_are_bounded(spark):
    """Before, ten thousand files or texts went to Python at once, and their paragraphs came back as one frame."""
    from marginalia.functions.batches import BATCH_BYTES, BATCH_ROWS
    from marginalia.operators import providers as P

    files = docx.export_lists(spark.range(900).select(
        F.col("id").alias("workspace"), F.lit(1).alias("position"), F.array(F.struct(F.lit(4).alias("level"), F.lit("h").alias("heading"))).alias("headings"), F.lit("t").alias("tag"),
        *(F.array().cast("array<struct<start int, end int, kind string>>").alias(c) for c in ("tag_markup", "markup")), *(F.lit("x").alias(c) for c in ("cite_short", "raw_cite", "card_text")), *(F.lit(None).cast("string").alias(c) for c in ("argument", "answer_to")),
    )).select(F.col("workspace").cast("string").alias("path"), "content")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = docx.paragraphs(files)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= BATCH_BYTES
    assert found.select("path").distinct().count() == 900 and found.count() == 900 * 5
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    P.embed(spark.createDataFrame([("a b", None)], "t string, embedding array<double>"), "t")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS


def test_lists_are_built_in_many_tasks(spark):
    """Before, adaptive execution put the few bytes of all lists into a few tasks, which build for long."""
    spans = "array<struct<start int, end int, kind string>>"
    entries = spark.range(200).select(F.col("id").alias("workspace"), F.lit(1).alias("position"), F.lit(None).cast("array<struct<level int, heading string>>").alias("headings"), *(F.lit(None).cast(spans).alias(c) for c in ("tag_markup", "markup")), *(F.lit("x").alias(c) for c in ("tag", "cite_short", "raw_cite", "card_text")), *(F.lit(None).cast("string").alias(c) for c in ("argument", "answer_to")))
    made = docx.export_lists(entries)
    assert made.select(F.spark_partition_id()).distinct().count() > spark.sparkContext.defaultParallelism and made.count() == 200
