"""Connected components by alternating star operations.

Each round is two grouped minima over the edge table, so no component, however
large, is ever gathered in one task; rounds grow with the logarithm of the
longest path. Every round is written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossbook.llm.common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the node's smallest neighbour."""
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                                          F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")
                        ).select("e.u", "e.v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u")
    return linked.select(F.explode(F.array(
        F.struct(F.col("m").alias("a"), F.col("u").alias("b")),
        F.struct(F.col("m").alias("a"), F.col("v").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b: bigint);
    the component is its smallest node. Nodes without edges are not listed."""
    edges = checkpointed(edges.where("a <> b").select(F.least("a", "b").alias("a"),
                                                      F.greatest("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())
        if state == before or state[0] == 0:
            break
        before = state
        edges = checkpointed(_small_star(_large_star(edges).distinct()).distinct())
    return edges.select(F.explode(F.array(
        F.struct(F.col("b").alias("node"), F.col("a").alias("component")),
        F.struct(F.col("a").alias("node"), F.col("a").alias("component")))).alias("x")).select("x.*").distinct()
