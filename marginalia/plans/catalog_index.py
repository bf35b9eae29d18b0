"""Queries over stored indexes, interval joins, keyed state, merges by bucket and incremental components, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators import gram_index as G
from marginalia.operators import intervals as I
from marginalia.operators import providers as P
from marginalia.operators import ranked_index as R
from marginalia.operators import vector_index as V
from marginalia.plans import catalog_changes as CC
from marginalia.plans import catalog_pages as CP
from marginalia.plans import tables as T
from marginalia.plans.catalog_changes import putter, shared_folder
from marginalia.plans.components import connected_components, merge_components, task_sizes, updated_components
from marginalia.streaming import limiter, timed
from marginalia.streaming.touched import BucketedSeen

CATALOG: dict[str, tuple] = {}

#: Folders of the indexes that this session has built, by session, name and input.
_BUILT: dict[tuple[str, str, str], str] = {}


def query(name: str, sql: str | None):
    def keep(fn):
        CATALOG[name] = (fn, sql)
        return fn

    return keep


def stored(spark, d: str, name: str, build) -> str:
    """The folder of an index over the tables in ``d``, built by the session's first query that needs it."""
    key = (spark.sparkContext.applicationId, name, d)
    if key not in _BUILT:
        path = shared_folder(spark, name)
        build(path)
        _BUILT[key] = path
    return _BUILT[key]


# Vectors -------------------------------------------------------------------------------------


def _vectors(spark, d) -> V.VectorIndex:
    rows = T.read(spark, d, "embeddings")
    return V.VectorIndex(spark, stored(spark, d, "vectors", lambda path: V.build(rows, path, "vec_id")))


@query("ann_topk", None)
def _(spark, d):
    return V.search(_vectors(spark, d), T.read(spark, d, "embeddings"), 8, id_col="vec_id")


_PAIRS = "SELECT x.vec_id AS a, y.vec_id AS b, 1 - list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS distance FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id"


@query("near_pairs_indexed", f"SELECT a, b, round(distance, 6)::DOUBLE AS distance FROM ({_PAIRS}) WHERE distance < 0.6")
def _(spark, d):
    return V.row_pairs_within(_vectors(spark, d), 0.6).withColumn("distance", F.round("distance", 6))


# Substrings ----------------------------------------------------------------------------------

# Wildcards between and inside pieces, a piece in any case, one that nothing holds, and two that are too short for a gram.
_PATTERNS = ("EXAMPLE.net", "th%.org/en/", "page=_&ref", "#top", "no such thing", "%fr", "/d")


@query("substring_index", " UNION ALL ".join(f"SELECT '{p}' AS pattern, page_id FROM pages WHERE url ILIKE '%{p}%'" for p in _PATTERNS))
def _(spark, d):
    pages = T.read(spark, d, "pages").select("page_id", "url")
    index = G.GramIndex(spark, stored(spark, d, "grams", lambda path: G.build(pages, path, "page_id", ["url"])))
    return reduce(DataFrame.union, [G.matching(pages, index, p, "page_id").select(F.lit(p).alias("pattern"), "page_id") for p in _PATTERNS])


# Ranked search -------------------------------------------------------------------------------

_TOP = "SELECT '{0}' AS query, doc_id, round(rank, 6)::DOUBLE AS rank FROM (SELECT doc_id, sum(weight * (1 + ln(tf)) / (1 + ln(doc_len))) AS rank FROM p WHERE term IN ({1}) GROUP BY doc_id HAVING {2}) ORDER BY round(rank, 6) DESC, doc_id DESC LIMIT 20"
_ASKED = {"the": ("'the'", "true"), "ther or src3": ("'ther', 'src3'", "true"), "ther the": ("'the', 'ther'", "count(DISTINCT term) = 2"), "thinsh": ("'thinsh'", "true")}


def _index(spark, d) -> R.RankedIndex:
    docs = T.read(spark, d, "documents")
    return R.RankedIndex(spark, stored(spark, d, "ranked", lambda path: R.save(docs, path, "doc_id", {"source": "A", "text": "B"})))


@query("search_top", f"WITH {CP._POST} " + " UNION ALL ".join(f"SELECT * FROM ({_TOP.format(q, *rest)})" for q, rest in _ASKED.items()))
def _(spark, d):
    index = _index(spark, d)
    return reduce(DataFrame.union, [R.top(index, q).select(F.lit(q).alias("query"), "doc_id", "rank") for q in _ASKED])


# Intervals -----------------------------------------------------------------------------------

_SPANS = "s AS (SELECT l_orderkey AS key, l_linenumber AS line, (l_partkey % 100)::BIGINT AS st, (l_partkey % 100 + l_quantity)::BIGINT AS en, l_returnflag = 'N' AS under FROM lineitem)"


def _spans(spark, d):
    """Underlines and highlights of each order: line items by their flag."""
    li = T.read(spark, d, "lineitem")
    start = F.col("l_partkey") % 100
    rows = li.select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), start.alias("start"), (start + F.col("l_quantity")).cast("long").alias("end"), (F.col("l_returnflag") == "N").alias("under"))
    return rows.where("under").drop("under"), rows.where("not under").drop("under")


@query("spans_contained", f"WITH {_SPANS} SELECT a.key, a.line AS line_a, b.line AS line_b FROM s a JOIN s b ON a.key = b.key AND a.under AND NOT b.under AND b.st <= a.st AND a.en <= b.en WHERE a.st < a.en")
def _(spark, d):
    under, over = _spans(spark, d)
    return I.contained(under, over).select(F.col("key_a").alias("key"), "line_a", "line_b")


@query("spans_clipped", f"WITH {_SPANS} SELECT a.key, a.line AS line_a, b.line AS line_b, greatest(a.st, b.st) - b.st AS clip_start, least(a.en, b.en) - b.st AS clip_end FROM s a JOIN s b ON a.key = b.key AND NOT a.under AND b.under AND a.st < b.en AND b.st < a.en WHERE a.st < a.en AND b.st < b.en")
def _(spark, d):
    under, over = _spans(spark, d)
    return I.clipped(over, under).select(F.col("key_a").alias("key"), "line_a", "line_b", "clip_start", "clip_end")


# State and merges ----------------------------------------------------------------------------


@query("sliding_limiter_stream", CC.CATALOG["sliding_limiter"][1])
def _(spark, d):
    """All events as a stream of three batches in order of time; state goes from batch to batch by the checkpoint."""
    folder = shared_folder(spark, "stream")
    events = T.read(spark, d, "events").select("event_id", "user_id", "ts")
    cuts = events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    low, high = cuts.stat.approxQuantile("us", [1 / 3, 2 / 3], 0.01) or [0.0, 0.0]
    buckets = timed.buckets_for(events.count() // 3)
    for part in (F.col("us") < low, (F.col("us") >= low) & (F.col("us") < high), F.col("us") >= high):
        # as many files as the scan has tasks; all of them are one batch, for the stream runs once for each part
        cuts.where(part).drop("us").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        limited = timed.limit_timed(stream, (limiter.Window(3, 43200.0),), "user_id", "ts", "event_id", buckets=buckets)
        with timed.rocksdb(spark):
            run = limited.select("id", "key", "allowed").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema("id long, key string, allowed boolean").parquet(f"{folder}/out")


@query("merge_touched", "SELECT user_id::VARCHAR AS file_sha256, min(ts::DATE)::VARCHAR AS first_seen, max(ts::DATE)::VARCHAR AS last_seen FROM events GROUP BY 1")
def _(spark, d):
    """All events in four batches by user, so that each rewrites some of the buckets."""
    folder = shared_folder(spark, "touched")
    table = BucketedSeen(spark, f"{folder}/table", f"{folder}/scratch", buckets=16)
    seen = T.read(spark, d, "events").select(F.col("user_id").cast("string").alias("file_sha256"), F.to_date("ts").alias("seen"), F.dayofmonth("ts").alias("day"))
    for lo, hi in ((1, 8), (9, 16), (17, 24), (25, 31)):
        table.merge(seen.where(F.col("day").between(lo, hi)))
    return CC._as_text(table.read().drop("bucket"), "first_seen", "last_seen")


# Components kept up to date ------------------------------------------------------------------


@query("components_incremental", CC.CATALOG["components"][1])
def _(spark, d):
    """The edges of the line items in three batches: components of the first, then two merges."""
    edges = T.read(spark, d, "lineitem").select((2 * F.col("l_orderkey")).alias("a"), (2 * F.col("l_partkey") + 1).alias("b"), (F.col("l_linenumber") % 3).alias("batch"))
    put = putter(spark, "incremental")
    with task_sizes(spark, edges.count()):
        labels = put(connected_components(edges.where("batch = 0").drop("batch"), put), "labels-0")
        for k in (1, 2):
            step = lambda df, name, k=k: put(df, f"{k}-{name}")
            changed = step(merge_components(labels, edges.where(f"batch = {k}").drop("batch"), step), "changed")
            labels = step(updated_components(labels, changed), "labels")
    return labels.select("node", "component")


# Samples -------------------------------------------------------------------------------------


@query("sample_stratified", "SELECT doc_id, lang, source, count(*) OVER (PARTITION BY lang, source) AS n, row_number() OVER (PARTITION BY lang, source ORDER BY md5(doc_id || ':3'), doc_id)::INTEGER AS place FROM documents QUALIFY place <= 5")
def _(spark, d):
    docs = T.read(spark, d, "documents").select("doc_id", "lang", "source")
    return P.stratified(docs, ["lang", "source"], 5, "doc_id", 3)
