"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import store

#: Files of a checkpoint for each core: where Hadoop has no native library, executors start a process for every file.
FILES = 4


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint of narrow rows in a few files, however many partitions there are."""
    return store.cut(df.coalesce(FILES * df.sparkSession.sparkContext.defaultParallelism))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of (a, b) edges is connected with.

    Each round hangs every node with a smaller neighbour on the smallest one, follows the trees to
    their roots by doubling, and puts the roots in the edges; what has become one node is dropped, so
    that edges dwindle from round to round. Loops and repeated edges do not matter. Nothing but flags
    comes to the driver.
    """
    nothing = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).where(F.lit(False))
    edges, found = cut(_downward(edges.select("a", "b"))), None
    while edges.limit(1).count():
        up = _to_roots(cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))))
        if found is None:
            found = up
        else:
            further = up.select(F.col("node").alias("component"), F.col("component").alias("top"))
            found = found.join(further, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
            found = cut(found.unionByName(up))
        upper, lower = (up.select(F.col("node").alias(c), F.col("component").alias(f"root_{c}")) for c in "ab")
        moved = edges.join(upper, "a").join(lower, "b", "left")
        edges = cut(_downward(moved.select(F.col("root_a").alias("a"), F.coalesce("root_b", "b").alias("b"))))
    if found is None:
        return nothing
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def _downward(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _to_roots(up: DataFrame) -> DataFrame:
    """(node, component) with the root of each node's tree in place of its parent."""
    while True:
        further = up.select(F.col("node").alias("component"), F.col("component").alias("top"))
        up = cut(up.join(further, "component", "left").select("node", F.coalesce("top", "component").alias("component"), F.isnotnull("top").alias("moved")))
        if not up.where("moved").limit(1).count():
            return up.select("node", "component")
        up = up.select("node", "component")
