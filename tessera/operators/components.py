"""Connected components by rounds of joins, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.scratch import forget, written


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for each node of edges (u, v): root is the least node that can be reached. A written table.

    Every round hangs a node's greater neighbours on its least one, then does
    the same with what each node now hangs on; when nothing changes, all edges
    lead to roots. Minima are aggregated before they meet the edges, so a node
    with many neighbours is no single task's. Nulls and edges from a node to
    itself add nothing; a node with no other edge than that is its own root.
    """
    ends = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    alone = ends.where("u = v").select(F.col("u").alias("root"), F.col("u").alias("node"))
    pairs = written(ends.where("u <> v").select(F.least("u", "v").alias("root"), F.greatest("u", "v").alias("node")).distinct())
    state = None
    while True:
        both = pairs.union(pairs.select("node", "root"))
        least = both.groupBy(F.col("root").alias("at")).agg(F.min("node").alias("low")).select("at", F.least("at", "low").alias("low"))
        hung = both.join(least, F.col("root") == F.col("at")).where("node > root").select(F.col("low").alias("root"), "node").distinct()
        low = hung.groupBy(F.col("node").alias("at")).agg(F.min("root").alias("low"))
        again = hung.join(low, F.col("node") == F.col("at"))
        up = again.where("root <> low").select(F.col("low").alias("root"), F.col("root").alias("node"))
        after = written(again.select(F.col("low").alias("root"), "node").union(up).distinct())
        now = after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("root", "node"))).first()
        forget(pairs)
        pairs = after
        if now == state:
            break
        state = now
    out = pairs.select("node", "root").union(pairs.select(F.col("root").alias("node"), "root"))
    out = written(out.union(alone.select("node", F.col("root"))).groupBy("node").agg(F.min("root").alias("root")))
    forget(pairs)
    return out
