"""Connected components by alternating large-star and small-star steps.

Each step links neighbours to the smallest number next to them, and repeats
until only stars are left. A round is two aggregations and two joins over
written tables, so a node with very many links is split by the engine's
skewed-join handling and no task or driver holds a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import cut, drop

#: Rounds needed grow with the logarithm of the longest chain.
MAX_ROUNDS = 60


def smallest(pairs: DataFrame) -> DataFrame:
    """For each node u of the pairs (u, v), the smallest v."""
    return cut(pairs.groupBy("u").agg(F.min("v").alias("m")))


def large_star(edges: DataFrame) -> DataFrame:
    """Links every neighbour above a node to the smallest number around the node."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = smallest(both)
    out = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    made = cut(out.distinct())
    drop(low)
    return made


def small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its neighbours below it to the smallest of them."""
    low = smallest(edges)
    joined = edges.join(low, "u")
    out = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    made = cut(out.union(low.select("u", F.col("m").alias("v"))).distinct())
    drop(low)
    return made


def connect(links: DataFrame) -> DataFrame:
    """Rows (node, root) for links (a, b): each node's smallest connected node.

    Roots have no row of their own; links from a node to itself are ignored.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        large = large_star(edges)
        now = small_star(large)
        drop(edges, large)
        edges = now
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
    raise RuntimeError(f"no stars after {MAX_ROUNDS} rounds")
