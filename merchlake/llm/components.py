"""Connected components by large-star and small-star rounds (each a grouping and a join, written to the shared folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlake.llm.common import discard, materialize


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """edges(a, b) between longs: one row (node, root) for each node of an edge, root the least node reachable.

    Every round replaces a node's edges by edges to its least neighbour, so edges never outnumber the input and
    a node of many edges meets only partial minima in the grouping and is split in the join; rounds grow with the logarithm of a component's diameter.
    """

    def star(e: DataFrame, large: bool, read: list[DataFrame]) -> DataFrame:
        # large: both ends look, and move their greater neighbours; small: the greater end moves its lesser ones
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        # written, so that the join reads two plain shuffles, whose skewed partitions Spark can split
        least = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), f"{name}-least")
        read.append(least)
        joined = both.join(least, "a")
        if large:
            return joined.where("b > a").select("m", F.col("b").alias("x"))
        return joined.select("m", F.col("b").alias("x")).unionByName(least.select("m", F.col("a").alias("x")))

    now, before = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges"), None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = mark
        read = []
        for large in (True, False):
            moved = star(now, large, read).where("m <> x").select(F.greatest("m", "x").alias("a"), F.least("m", "x").alias("b")).distinct()
            read.append(now)
            now = moved if large else materialize(moved, f"{name}-round")
        discard(*read)
