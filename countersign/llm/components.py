"""Connected components of an edge table by alternating star contraction."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countersign.session import checkpointed


def stars(edges: DataFrame) -> DataFrame:
    """`node, root` of every node of `a, b` edges except the roots; a root is its component's smallest node.

    Each pass links larger neighbours to a node's smallest neighbour, then smaller ones likewise, until every node hangs on its root.
    Minima aggregate before the shuffle, and no task sees a node's neighbours together.
    """
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct())
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or mark["n"] == 0:
            return now.select(F.col("x").alias("node"), F.col("y").alias("root"))
        before = mark
        ways = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = ways.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = checkpointed(ways.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct())
        small = large.groupBy("x").agg(F.min("y").alias("m"))
        down = large.join(small, "x").where("y > m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        now = checkpointed(down.unionByName(small.select("x", F.col("m").alias("y"))).distinct())
