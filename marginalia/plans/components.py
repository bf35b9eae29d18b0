"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014).

Each step is two shuffles of the edge list.  Per-node minima are combined on the map
side first.  A node with very many edges makes one key of the join hot: both sides of
that join come straight from an exchange (``splittable_join``), the shape that adaptive
execution can split.  Nothing is collected: the driver sees one checksum row a round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def splittable_join(rows: DataFrame, totals: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``totals``, an aggregate by ``key`` (a long), so that adaptive execution can split a hot key.

    An aggregate already lies partitioned by its key, and the planner would join it as it
    is; but it splits a skewed partition only where both sides of the join are exchanges.
    A second key, a function of the first, makes it put one there.
    """
    also = f"_{key}_again"
    return rows.withColumn(also, F.bitwise_not(F.col(key))).join(totals.withColumn(also, F.bitwise_not(F.col(key))), [key, also], how).drop(also)


#: Edges of a task, and bytes to which adaptive execution may lay tasks together.
TASK_EDGES, TASK_BYTES = 1_000_000, 16 << 20


@contextmanager
def task_sizes(spark: SparkSession, edges: int) -> Iterator[None]:
    """Shuffles that run inside have partitions of a bounded number of edges, so a task's memory doesn't follow the input.

    The session's number of partitions is only ever raised, its size of one only lowered; both come back afterwards.
    """
    parts, size = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = {k: spark.conf.get(k, None) for k in (parts, size)}
    wanted = -(-edges // TASK_EDGES)
    try:
        if wanted > int(before[parts] or 200):
            spark.conf.set(parts, str(wanted))
        if edges > TASK_EDGES and str(before[size] or "64mb").lower() in ("64mb", "64m", "67108864", "67108864b"):
            spark.conf.set(size, str(TASK_BYTES))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


#: Edges from which on a hot node is worth two exchanges more a round.
MANY_EDGES = 1_000_000


def _large_star(edges: DataFrame, many: bool) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = splittable_join(both, least, "a") if many else both.join(least, "a")
    return joined.where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, many: bool) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = splittable_join(edges, least, "a") if many else edges.join(least, "a")
    moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, put: Callable[[DataFrame, str], DataFrame], drop: Callable[[str], None] = lambda name: None, most_rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node id reached) for every node of an edge.

    ``edges`` has columns ``a`` and ``b``.  ``put(df, name)`` stores a table where all
    executors see it and returns it read back; ``drop(name)`` may delete one.  Nodes of
    self-loops only, and nodes without edges, aren't returned.  Null ends are ignored.
    """
    start = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, name, seen = put(start, "edges-0"), "edges-0", None
    n = now.count()
    many = n > MANY_EDGES  # edges only get fewer, but for the small star's roots
    with task_sizes(edges.sparkSession, 2 * n):  # the large star takes them in both directions
        for k in range(1, most_rounds + 1):
            after = put(_small_star(_large_star(now, many), many), f"edges-{k}")
            drop(name)
            now, name = after, f"edges-{k}"
            state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if state == seen or not state[0]:
                break
            seen = state
        else:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def merge_components(labels: DataFrame, edges: DataFrame, put: Callable[[DataFrame, str], DataFrame], drop: Callable[[str], None] = lambda name: None) -> DataFrame:
    """``node, component`` of the nodes whose component changes when ``edges`` (a, b) join a graph with ``labels`` (node, component).

    The ends of the new edges take their stored component, so that only components that
    a new edge touches are looked at, as single nodes of a contracted graph.  Nodes
    without a stored label are components of their own, and are always returned.  Only
    the labels of contracted components that aren't the smallest of theirs change; the
    caller keeps the other stored labels as they are.
    """
    new = put(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "new")
    ends = new.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    placed = put(ends.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("at"), F.col("component").isNull().alias("fresh")), "ends")
    a, b = (placed.select(F.col("node").alias(c), F.col("at").alias(f"at_{c}")) for c in "ab")
    contracted = new.join(a, "a").join(b, "b").select(F.col("at_a").alias("a"), F.col("at_b").alias("b"))
    merged = put(connected_components(contracted, lambda df, name: put(df, f"merge-{name}"), lambda name: drop(f"merge-{name}")), "merged")
    moved = merged.where("node <> component").select(F.col("node").alias("was"), F.col("component").alias("now"))
    old = splittable_join(labels.withColumnRenamed("component", "was"), moved, "was").select("node", F.col("now").alias("component"))
    fresh = placed.where("fresh").join(merged.withColumnRenamed("node", "at"), "at", "left").select("node", F.coalesce("component", "at").alias("component"))
    return old.union(fresh)


def updated_components(labels: DataFrame, changed: DataFrame) -> DataFrame:
    """``labels`` with the changed ones in place of theirs, and the new ones."""
    return labels.join(changed.select("node"), "node", "left_anti").select("node", "component").union(changed.select("node", "component"))
