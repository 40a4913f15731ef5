"""Connected components of an edge table, kept distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlink.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` with the smallest reachable node as root, for nodes of ``(a, b)``.

    Alternating large-star and small-star steps: a node's larger (then smaller) neighbours
    are tied to the smallest node around it. The edge table never grows, each step is a
    grouped minimum and a join, and its result is written to the shared folder. It ends when
    a round changes nothing, after a number of rounds logarithmic in the longest chain.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low"))
        low = F.least("a", "low")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), low.alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(small.select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        edges = materialize(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == now:
            break
        before = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
