"""Connected components of an edge table, kept distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlink.scratch import materialize


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest node reachable from every node of ``(a, b)``.

    Each round points every node at one of its neighbours or itself and puts the graph of these
    in place of the old one, until no edge is left. The smallest neighbour is taken first, which
    settles stars; after that the order is drawn anew for each round, so that any graph, a long
    chain too, shrinks by a constant part. Rounds after the first thus work on few rows.
    """
    once = lambda e: e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, levels = materialize(once(edges), "components"), []
    while not levels or not left.isEmpty():
        rank = lambda c: F.xxhash64(c, F.lit(len(levels))) if levels else F.col(c)  # noqa: B023, E731
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min_by("b", rank("b")).alias("to"))
        point = materialize(near.select(F.col("a").alias("node"), F.when(rank("a") <= rank("to"), F.col("a")).otherwise(F.col("to")).alias("to")), "components")
        moved = left.join(point.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(point.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        left = materialize(once(moved.select(F.col("x").alias("a"), F.col("y").alias("b"))), "components")
        levels.append(point)
    labels = levels.pop()
    while levels:
        further = labels.select(F.col("node").alias("to"), F.col("to").alias("last"))
        labels = levels.pop().join(further, "to", "left").select("node", F.coalesce("last", "to").alias("to"))
    labels = materialize(labels, "components")
    least = labels.groupBy("to").agg(F.min("node").alias("root"))
    return materialize(labels.join(least, "to").select("node", "root"), "components")
