"""Connected components of tables of edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions, written


def _held(df: DataFrame) -> DataFrame:
    """df as a written table; its narrow rows are put together in an eighth of the tasks, each of which would write a file."""
    return written(df.coalesce(partitions(df.sparkSession) // 8 + 1))


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) of the nodes on edges (a < b) that are not the smallest of theirs.

    In each round a node hangs below its least smaller neighbour, and its other smaller
    neighbours are tied to that one instead: what many nodes of a dense group say of the same
    few becomes one edge.  The trees are flattened, and the remaining edges move to their roots.
    Every table is written, so that joins know its size: small ones are broadcast by Spark's own
    threshold, skewed ones are split.  The result is a written table (see ``discard``).
    """
    edges, label = _held(edges.select("a", "b")), None
    while True:
        least = _held(edges.groupBy("b").agg(F.min("a").alias("up"), F.count("*").alias("n")))
        tied = edges.join(least.where("n > 1").drop("n"), "b").where("a <> up").select(F.col("up").alias("a"), F.col("a").alias("b"))
        tied = _held(tied.distinct())
        tree = _flat(least.select(F.col("b").alias("node"), "up"))
        discard(least, edges)
        if label is None:
            label = tree
        else:
            root = tree.select(F.col("node").alias("up"), F.col("up").alias("root"))
            moved = _held(label.join(root, "up", "left").select("node", F.coalesce("root", "up").alias("up")).union(tree))
            discard(label)
            label = moved
        if tied.isEmpty():
            discard(tied)
            return label.select("node", F.col("up").alias("label"))
        moved = tied
        for end in ("a", "b"):
            moved = moved.join(tree.select(F.col("node").alias(end), F.col("up").alias("root")), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        edges = _held(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        discard(tied, *([tree] if label is not tree else []))
        if edges.isEmpty():
            discard(edges)
            return label.select("node", F.col("up").alias("label"))


def _flat(tree: DataFrame) -> DataFrame:
    """node, up: each node below its root, by pointer jumping; up < node."""
    last = None
    while True:
        above = tree.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = _held(tree.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
        if last is not None:
            discard(last)
        last, tree = step, step.select("node", "up")
        if step.where("moved").isEmpty():
            return tree
