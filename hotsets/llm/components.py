"""Connected components of an edge list, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotsets.llm.common import handoff


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from every node that has an edge.

    ``edges``: columns ``a`` and ``b`` (same orderable type; direction, repeats and loops do not
    matter).  Returns ``node``, ``root`` for the nodes that occur in it.  Alternates large-star
    and small-star rounds: every node hangs its larger (then its smaller) neighbours on its
    smallest neighbour until nothing changes.  Each round is an aggregation (combined before the
    shuffle) and a join on the node (a node with many edges is a skewed join key, which adaptive
    execution splits).  An empty edge list gives an empty result.  Raises if ``max_rounds`` do
    not settle it, rather than returning a partial answer.
    """
    e = handoff(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    for _ in range(max_rounds):
        # large star: neighbours above a node move to the smallest of its neighbourhood
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").where("v != m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: neighbours below a node, and the node, move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u")
        small = (moved.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        e = handoff(small)
        now = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == last:
            roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        last = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
