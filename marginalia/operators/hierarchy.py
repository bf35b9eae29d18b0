"""A forest of tags: closure, subtree totals, sidebar.

The closure is built by doubling: each round joins paths to paths, so a tree of depth d
takes log2(d) rounds.  Nodes on a cycle have no root and vanish, with what hangs on them;
a node whose parent is missing is a root.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def roots(tags: DataFrame) -> DataFrame:
    """``tag_id, parent_id`` with the parent null where it doesn't exist."""
    known = tags.select(F.col("tag_id").alias("p"))
    t = tags.select("tag_id", "parent_id")
    return t.join(known, t["parent_id"] == known["p"], "left").select("tag_id", F.col("p").alias("parent_id"))


def closure(tags: DataFrame, put: Callable[[DataFrame, str], DataFrame] | None = None, most_rounds: int = 40) -> DataFrame:
    """``ancestor, descendant, depth``, each node below itself at depth 0; nodes on cycles and below them have no row.

    ``put(df, name)`` stores a round's table where all executors see it; without it rounds
    are checkpointed in ``spark.checkpoint.dir``.  Depths beyond 2 ** most_rounds can only
    come from an endless input and raise.
    """
    put = put or checkpointed(tags)
    edges = put(roots(tags), "edges")
    parents = edges.where("parent_id is not null").select(F.col("parent_id").alias("ancestor"), F.col("tag_id").alias("descendant"), F.lit(1).alias("depth"))
    n = edges.count()
    # steps: pairs exactly 2 ** k apart; every: pairs up to that
    every = put(edges.select(F.col("tag_id").alias("ancestor"), F.col("tag_id").alias("descendant"), F.lit(0).alias("depth")).union(parents), "every-0")
    steps = put(parents, "steps-0")
    for k in range(1, most_rounds + 1):
        if steps.isEmpty() or 2 ** (k - 1) > n:  # chains longer than the number of nodes run in a cycle
            break
        up = steps.select(F.col("descendant").alias("_m"), F.col("ancestor").alias("_a"), F.col("depth").alias("_d"))
        further = every.where("depth > 0").join(up, F.col("ancestor") == F.col("_m")).select(F.col("_a").alias("ancestor"), "descendant", (F.col("depth") + F.col("_d")).alias("depth"))
        next_steps = steps.join(up, F.col("ancestor") == F.col("_m")).select(F.col("_a").alias("ancestor"), "descendant", (F.col("depth") + F.col("_d")).alias("depth"))
        every, steps = put(every.union(further), f"every-{k}"), put(next_steps, f"steps-{k}")
    else:
        raise ValueError(f"the hierarchy is deeper than 2 ** {most_rounds}")
    # what still has an ancestor as many steps away as there are nodes hangs on a cycle
    endless = steps.select(F.col("descendant").alias("_e")).distinct()
    return every.join(endless, F.col("descendant") == F.col("_e"), "left_anti")


def checkpointed(df: DataFrame) -> Callable[[DataFrame, str], DataFrame]:
    """A ``put`` by reliable checkpoints; only a local master may go without a folder for them, and then stores tables in a temporary one."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return lambda rows, name: rows.checkpoint()
    if not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="marginalia-closure-")
    atexit.register(shutil.rmtree, folder, True)

    def put(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"file://{folder}/{name}")
        return spark.read.parquet(f"file://{folder}/{name}")

    return put


def descendants(spark: SparkSession, view: str, root: int) -> DataFrame:
    """The subtree of one node by a recursive query over a view of (tag_id, parent_id); duplicates end a cycle.

    No path without a repeat has more steps than the view has rows, so that is the limit.
    """
    n = spark.table(view).count()
    return spark.sql(f"""
        WITH RECURSIVE sub(tag_id, depth) MAX RECURSION LEVEL {n + 2} AS (
            SELECT tag_id, 0 FROM {view} WHERE tag_id = {int(root)}
            UNION ALL
            SELECT t.tag_id, s.depth + 1 FROM {view} t JOIN sub s ON t.parent_id = s.tag_id WHERE s.depth < {n}
        ) SELECT tag_id, min(depth) AS depth FROM sub GROUP BY tag_id""")


def usage(tags: DataFrame, *links: DataFrame) -> DataFrame:
    """``tag_id`` with ``own`` links of all kinds, hidden cards and both statuses included; 0 where there are none."""
    out = tags.select("tag_id")
    total = F.lit(0).cast("long")
    for k, link in enumerate(links):
        n = link.groupBy(F.col("tag_id").alias(f"t{k}")).agg(F.count("*").alias(f"n{k}"))
        out = out.join(n, F.col("tag_id") == F.col(f"t{k}"), "left").drop(f"t{k}")
        total = total + F.coalesce(f"n{k}", F.lit(0))
    return out.select("tag_id", total.alias("own"))


def rollup(closed: DataFrame, used: DataFrame) -> DataFrame:
    """``tag_id, total``: links of the node and of all below it; a card tagged twice on one path counts twice."""
    below = closed.join(used, closed["descendant"] == used["tag_id"])
    return below.groupBy("ancestor").agg(F.sum("own").alias("total")).withColumnRenamed("ancestor", "tag_id")


def sidebar(tags: DataFrame, closed: DataFrame, totals: DataFrame, label: str = "label") -> DataFrame:
    """Roots by total, then their children by name: ``root_id, tag_id, label, total, depth``, in display order."""
    shown = closed.join(roots(tags).where("parent_id is null").select(F.col("tag_id").alias("r")), F.col("ancestor") == F.col("r"), "left_semi").where("depth <= 1")
    sums = totals.select(F.col("tag_id").alias("t"), "total")
    tops = totals.select(F.col("tag_id").alias("t2"), F.col("total").alias("root_total"))
    names = tags.select(F.col("tag_id").alias("t3"), label)
    out = shown.join(sums, F.col("descendant") == F.col("t")).join(tops, F.col("ancestor") == F.col("t2")).join(names, F.col("descendant") == F.col("t3"))
    out = out.select(F.col("ancestor").alias("root_id"), F.col("descendant").alias("tag_id"), label, "total", "depth", "root_total")
    return out.orderBy(F.col("root_total").desc(), "root_id", "depth", label).drop("root_total")
