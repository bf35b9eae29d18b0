"""A stored inverted-file index of vectors for approximate nearest neighbours by cosine distance.

``build`` brings vectors to unit length, makes one class of equal ones, finds centres by
k-means on a bounded sample, and stores each class in the folder of its nearest centre.
Centres that draw far more of the sample than others are split by k-means of their own,
so that a third of all vectors in one spot doesn't become one list.  ``search`` compares a
query with the vectors of its ``probes`` nearest lists only, in blocks of bounded size;
with few queries only those folders are read.  How many lists that takes is measured when
the index is built: a bounded number of indexed vectors is compared with all vectors, and
the fewest probes that find the wanted share of their true neighbours become the default
(vectors without any structure take most lists, clustered ones a few).  ``pairs_within`` is exact: each list knows
how far it reaches from its centre, so a list that can't hold a near vector is left out
by the triangle inequality of angles, and no other.  It names classes by their first rows;
``row_pairs_within`` has the pairs of all rows.

There are about as many lists as the square root of the vectors, MOST_LISTS at most, so
the centres stay small enough for a broadcast.

Rows whose vector is null, without length or not finite have no distance and aren't indexed.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.vectors import unit
from marginalia.operators import tiles
from marginalia.plans.components import splittable_join

MOST_LISTS = 4096
#: Rows of the sample for each list, and times the mean at which a list is split.
SAMPLE, OVERFULL = 64, 4
#: Vectors that measure the probes, neighbours of each, and the share of these to find, a little above the 0.95 promised.
MEASURED, NEAREST, RECALL = 256, 8, 0.97
#: Rows of a class that are stored together, about; so many times so many pairs come of two such parts in one place.
PART = 256
#: What rounding may do to an angle: the arc cosine near 1 has half the digits.
ANGLE_SLACK = 1e-6


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy())


class VectorIndex:
    """An index stored under ``path``: ``lists`` (by folder), ``members`` (rep, id, part), ``parts`` (rep, part, ids), ``centres``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/centres").orderBy("list").collect()  # MOST_LISTS rows and their splits at most
        self.centres = np.array([r["centre"] for r in rows]) if rows else np.zeros((0, 0))
        self.reach = np.array([r["reach"] for r in rows])  # the largest angle of a vector of the list to its centre
        self.sizes = {k: r["n"] for k, r in enumerate(rows)}
        self.probes = spark.read.parquet(f"{path}/probes").first()["probes"] if rows else 0

    def lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")

    def members(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/members")

    def parts(self) -> DataFrame:
        """The ids of each class of several rows, in parts of about PART."""
        return self.spark.read.parquet(f"{self.path}/parts")


def _centres(sample: DataFrame, k: int, seed: int) -> np.ndarray:
    """Unit centres of about ``k`` clusters of the sample (v); overfull clusters are split, twice at most."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = sample.select(array_to_vector("v").alias("features"), "v")

    def fit(rows: DataFrame, k: int) -> np.ndarray:
        found = np.array(KMeans(k=max(2, k), seed=seed, maxIter=12, initMode="random").fit(rows).clusterCenters())
        size = np.linalg.norm(found, axis=1)
        return found[size > 0] / size[size > 0, None]

    out = fit(points, k)
    for _ in range(2):
        nearest = points.withColumn("list", _nearest(out, 1)("v")[0])
        full = {r["list"]: r["count"] for r in nearest.groupBy("list").count().collect()}  # a row for each centre
        mean = sum(full.values()) / len(out)
        over = [c for c, n in full.items() if n > OVERFULL * mean and n >= 32]
        if not over:
            break
        parts = [fit(nearest.where(F.col("list") == c), math.ceil(full[c] / mean)) for c in over]
        out = np.vstack([np.delete(out, over, axis=0), *parts])
    return out


def _nearest(centres: np.ndarray, probes: int, reach: np.ndarray | None = None, within: float = 0.0):
    """A function of a unit vector: its nearest centres' numbers; with ``reach`` all whose list may hold a vector nearer than the angle ``within``."""

    @F.pandas_udf("array<int>")
    def near(vectors: pd.Series) -> pd.Series:
        cos = np.clip(_stack(vectors) @ centres.T, -1, 1)
        if reach is not None:
            return pd.Series([np.flatnonzero(x).astype(np.int32) for x in np.arccos(cos) - reach[None, :] <= within + ANGLE_SLACK])
        few = min(probes, len(centres))
        best = np.argpartition(-cos, few - 1, axis=1)[:, :few]
        order = np.argsort(-np.take_along_axis(cos, best, 1), axis=1, kind="stable")  # the nearest first
        return pd.Series(list(np.take_along_axis(best, order, 1).astype(np.int32)))

    return near


def build(rows: DataFrame, path: str, id_col: str = "id", vector_col: str = "embedding", lists: int | None = None, seed: int = 7) -> VectorIndex:
    """Index ``rows`` under ``path``; an id names one row."""
    spark = rows.sparkSession
    kept = rows.select(F.col(id_col).cast("long").alias("id"), unit(F.col(vector_col)).alias("v")).where("v is not null and id is not null")
    classes = kept.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    classes.write.parquet(f"{path}/classes")
    classes = spark.read.parquet(f"{path}/classes")
    n = classes.count()
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / PART)).cast("int")
    kept.join(classes.where("n > 1").select("v", "rep", "n"), "v").select("rep", "id", part.alias("part")).distinct().write.parquet(f"{path}/members")
    spark.read.parquet(f"{path}/members").groupBy("rep", "part").agg(F.collect_list("id").alias("ids")).write.parquet(f"{path}/parts")
    if not n:
        spark.createDataFrame([], "rep long, v array<double>, list int").write.parquet(f"{path}/lists")
        spark.createDataFrame([], "list int, centre array<double>, reach double, n long").write.parquet(f"{path}/centres")
        return VectorIndex(spark, path)
    k = min(MOST_LISTS, lists or math.ceil(math.sqrt(n)))
    if k > 1:
        sample = classes.where(F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(1 << 20)) < (1 << 20) * min(1.0, 1.2 * SAMPLE * k / n)).orderBy("rep").limit(SAMPLE * k)
        centres = _centres(sample, k, seed)
    else:
        centres = np.array([classes.first()["v"]])
    dealt = classes.select("rep", "v", _nearest(centres, 1)("v")[0].alias("list")).repartition("list", F.pmod(F.xxhash64("rep"), F.lit(8)))
    dealt.write.partitionBy("list").parquet(f"{path}/lists")
    told = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>")
    cos = F.aggregate(F.zip_with("v", "centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))
    sizes = spark.read.parquet(f"{path}/lists").join(F.broadcast(told), "list").groupBy("list").agg(F.max(angle).alias("reach"), F.count("*").alias("n"))
    told.join(sizes, "list", "left").select("list", "centre", F.coalesce("reach", F.lit(-4.0)).alias("reach"), F.coalesce("n", F.lit(0)).cast("long").alias("n")).coalesce(1).write.parquet(f"{path}/centres")
    told = _probes(spark.read.parquet(f"{path}/lists"), centres)
    spark.createDataFrame([(told,)], "probes int").write.parquet(f"{path}/probes")
    return VectorIndex(spark, path)


def _probes(lists: DataFrame, centres: np.ndarray) -> int:
    """The fewest probes with which MEASURED indexed vectors find RECALL of their NEAREST neighbours, from one pass over the index."""
    asked = lists.orderBy(F.xxhash64("rep", F.lit(11))).limit(MEASURED).select("rep", "v").toPandas()  # MEASURED rows
    ids, q = asked.rep.to_numpy(), _stack(asked.v)

    def nearest(pdfs):
        for pdf in pdfs:
            if len(pdf):
                d = 1 - _stack(pdf.v) @ q.T
                d[pdf.rep.to_numpy()[:, None] == ids[None, :]] = np.inf
                few = min(NEAREST, len(pdf))
                best = np.argpartition(d, few - 1, axis=0)[:few]
                yield pd.DataFrame({"q": np.tile(np.arange(len(ids)), few), "rep": pdf.rep.to_numpy()[best].ravel(), "list": pdf.list.to_numpy()[best].ravel(), "distance": np.take_along_axis(d, best, 0).ravel()})

    met = lists.mapInPandas(nearest, "q int, rep long, list int, distance double").where("distance < 4")
    met = met.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy("distance", "rep"))).where(F.col("nth") <= NEAREST).select("q", "list").toPandas()
    rank = np.argsort(np.argsort(-(q @ centres.T), axis=1, kind="stable"), axis=1)
    places = np.sort(rank[met.q.to_numpy(), met.list.to_numpy()])
    return int(places[math.ceil(RECALL * len(places)) - 1]) + 1 if len(places) else 1


def _packs(index: VectorIndex) -> dict[int, list[int]]:
    """Each list's packs: small lists that lie along one direction share one, a large list has several.

    There are so few packs that a vector is sent a fixed number of times, unless a pack would grow too large for a task.
    """
    n = sum(index.sizes.values())
    full = math.ceil(n / tiles.blocks(n, index.centres.shape[1]))
    middle = index.centres - index.centres.mean(axis=0)
    along = middle @ np.linalg.svd(middle, full_matrices=False)[2][0]
    out, pack, room = {}, 0, full
    for c in np.argsort(along, kind="stable").tolist():
        n = index.sizes[c]
        if n > room and room < full:
            pack, room = pack + 1, full
        parts = max(1, math.ceil(n / full))
        out[c] = list(range(pack, pack + parts))
        pack, room = (pack + parts, full) if parts > 1 else (pack, room - n)
    return out


def _dealt(index: VectorIndex, asked: DataFrame, least_probed: int = 256) -> DataFrame:
    """``i, j, id, v, asks``: queries (id, v, lists) and indexed vectors, as pairs of packs of bounded size.

    Queries are packed by their first list, vectors by theirs.  Two packs meet if some
    query of the one probes a list of the other, and then whole: a query may see more
    lists than it probes, never fewer.  So a vector is sent once for each pack that asks
    for its list, not once for each query.
    """
    spark = index.spark
    told = spark.createDataFrame([(c, p) for c, p in _packs(index).items()], "list int, packs array<int>")  # a row for each list
    told = F.broadcast(told)
    own = lambda c: F.col("packs")[F.pmod(F.xxhash64(c), F.size("packs")).cast("int")]
    left = asked.withColumn("list", F.col("lists")[0]).join(told, "list").select("id", "v", "lists", own("id").alias("i"))
    at = f"{index.path}/asked-{uuid.uuid4().hex}"
    left.write.parquet(at)  # the centres are compared once
    left = spark.read.parquet(at)
    probed = left.select("i", F.explode("lists").alias("list")).distinct()
    wanted = [r[0] for r in probed.select("list").distinct().limit(least_probed + 1).collect()]
    base = index.lists()
    if len(wanted) <= least_probed:
        base = base.where(F.col("list").isin(wanted))  # only their folders are read
    meet = probed.join(told, "list").select("i", F.explode("packs").alias("j")).distinct()
    to_j, to_i = (meet.groupBy(x).agg(F.sort_array(F.collect_set(y)).alias("to")) for x, y in (("i", "j"), ("j", "i")))  # a number for each pack
    right = base.join(told, "list").select("rep", "v", own("rep").alias("j"))
    sent = splittable_join(left.withColumn("i", F.col("i").cast("long")), to_j.withColumn("i", F.col("i").cast("long")), "i").select(F.col("i").cast("int").alias("i"), F.explode("to").alias("j"), "id", "v", F.lit(True).alias("asks"))
    given = splittable_join(right.withColumn("j", F.col("j").cast("long")), to_i.withColumn("j", F.col("j").cast("long")), "j").select(F.explode("to").alias("i"), F.col("j").cast("int").alias("j"), F.col("rep").alias("id"), "v", F.lit(False).alias("asks"))
    return sent.union(given)


def search(index: VectorIndex, queries: DataFrame, k: int = 8, probes: int | None = None, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """``a, b, distance, rn``: for each query row ``a`` the ``k`` nearest indexed rows ``b`` of other ids that its lists hold; ties go to the smaller id."""
    empty = "a long, b long, distance double, rn int"
    if not index.sizes:
        return index.spark.createDataFrame([], empty)
    asked = queries.select(F.col(id_col).cast("long").alias("id"), unit(F.col(vector_col)).alias("v")).where("v is not null and id is not null")
    classes = asked.groupBy("v").agg(F.min("id").alias("id"))
    probed = classes.select("id", "v", _nearest(index.centres, probes or index.probes)("v").alias("lists"))

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.asks], pdf[~pdf.asks].sort_values("id")
        if a.empty or b.empty:
            return pd.DataFrame({"q": [], "rep": [], "distance": []}).astype({"q": "int64", "rep": "int64", "distance": "float64"})
        r, c, d = tiles.nearest(_stack(a.v), _stack(b.v), k + 1)  # a query's own class may be among them
        return pd.DataFrame({"q": a.id.to_numpy()[r], "rep": b.id.to_numpy()[c], "distance": np.round(d, tiles.DIGITS)})

    found = _dealt(index, probed).groupBy("i", "j").applyInPandas(nearest, "q long, rep long, distance double")
    order = Window.partitionBy("q").orderBy("distance", "rep")
    found = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1).drop("nth")
    # of a class of equal vectors the k + 1 smallest ids are enough for any query
    first = index.members().withColumn("nth", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("nth") <= k + 1).groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    named = found.join(first, "rep", "left").select("q", "distance", F.explode(F.coalesce("ids", F.array("rep"))).alias("b"))
    lists = named.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("distance", "b"))).alias("best"))
    lists = lists.select("q", F.slice("best", 1, k + 1).alias("best"))
    # every row of a class has the class' list, without itself
    rows = asked.join(classes.select("v", F.col("id").alias("q")), "v").select(F.col("id").alias("a"), "q")
    out = splittable_join(rows, lists, "q").select("a", F.posexplode(F.slice(F.filter("best", lambda x: x["b"] != F.col("a")), 1, k)).alias("rn", "x"))
    return out.select("a", F.col("x.b").alias("b"), F.col("x.distance").alias("distance"), (F.col("rn") + 1).cast("int").alias("rn"))


def pairs_within(index: VectorIndex, threshold: float, copies: bool = True) -> DataFrame:
    """``a < b, distance``: all pairs of classes nearer than ``threshold``, by their first rows, and unless without ``copies`` each class' first row with them."""
    if not index.sizes:
        return index.spark.createDataFrame([], "a long, b long, distance double")
    angle = math.acos(max(-1.0, min(1.0, 1 - threshold)))
    probed = index.lists().select(F.col("rep").alias("id"), "v", "list", _nearest(index.centres, 0, index.reach, angle)("v").alias("lists"))
    probed = probed.select("id", "v", F.concat(F.array("list"), F.array_remove("lists", F.col("list"))).alias("lists"))  # its own list first

    none = pd.DataFrame({"a": [], "b": [], "distance": []}).astype({"a": "int64", "b": "int64", "distance": "float64"})

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.asks], pdf[~pdf.asks]
        if a.empty or b.empty:
            return none
        ids_a, ids_b = a.id.to_numpy(), b.id.to_numpy()
        out = [none]
        for lo, at, r, c, d in tiles.near(_stack(a.v), _stack(b.v), threshold):
            s, t = ids_a[lo + r], ids_b[at + c]
            out.append(pd.DataFrame({"a": s[s < t], "b": t[s < t], "distance": d[s < t]}))
        return pd.concat(out, ignore_index=True)

    found = _dealt(index, probed).groupBy("i", "j").applyInPandas(near, "a long, b long, distance double")
    if not copies or threshold <= 0:
        return found
    return found.union(index.members().where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("distance")))


def row_pairs_within(index: VectorIndex, threshold: float) -> DataFrame:
    """``a < b, distance``: all pairs of rows nearer than ``threshold``, copies among themselves and with every neighbour of theirs too."""
    between = pairs_within(index, threshold, copies=False)
    if not index.sizes or threshold <= 0:
        return between
    for end in ("a", "b"):
        between = between.join(index.parts().select(F.col("rep").alias(end), F.col("ids").alias(f"{end}s")), end, "left")
    between = between.select("distance", F.coalesce("bs", F.array("b")).alias("bs"), F.explode(F.coalesce("as", F.array("a"))).alias("a")).select("distance", "a", F.explode("bs").alias("b"))
    between = between.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")
    left, right = (index.parts().select("rep", F.col("part").alias(p), F.col("ids").alias(ids)) for p, ids in (("p", "as"), ("q", "bs")))
    # a row for two parts goes to any task, or a large class would be paired in one
    inside = left.join(right, "rep").where("p <= q").repartition("rep", "p", "q").select("p", "q", "bs", F.explode("as").alias("a")).select("p", "q", "a", F.explode("bs").alias("b")).where("p < q or a < b")
    return between.union(inside.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(0.0).alias("distance")))
