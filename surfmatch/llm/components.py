"""Connected components by alternating large-star and small-star steps, each a join and an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfmatch.llm.common import drop_table, materialize


def signature(tree: DataFrame) -> tuple:
    return tuple(tree.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "parent"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of edges(a, b); longs; loops and repeats are harmless.

    Rounds go on until nothing moves: parents only ever get smaller, so that ends. Each
    round halves the depth of every tree or better.
    """
    tree = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("parent")).distinct(), "cc"
    )
    last = signature(tree)
    while True:
        # large star: every node's larger neighbours, and itself, move to its smallest neighbour
        both = tree.union(tree.select("parent", "node")).toDF("node", "other")
        least = both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("m"))
        large = both.where("other > node").join(least, "node").select(F.col("other").alias("node"), F.col("m").alias("parent")).where("node <> parent").distinct()
        # small star: every node and its smaller neighbours move to the smallest of them
        small = large.groupBy("node").agg(F.min("parent").alias("m"))
        new = large.join(small, "node")
        new = new.select(F.col("parent").alias("node"), F.col("m").alias("parent")).union(small.select("node", "m")).where("node <> parent").distinct()
        new = materialize(new.toDF("node", "parent"), "cc")
        sign = signature(new)
        drop_table(tree)
        tree = new
        if sign == last:  # nothing moved, so every parent is a root
            break
        last = sign
    roots = tree.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct()
    return tree.select("node", F.col("parent").alias("component")).union(roots)
