"""An adaptive sweep of a source that shows no more than so many results for a cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sweep(points: DataFrame, box: tuple[float, float, float, float], cap: int = 45, depth: int = 14) -> DataFrame:
    """The cells (depth, qy, qx, n) at which the sweep stops: n is at most cap, and more in the cell above.

    Cells are quarters of quarters of the box (low lng, low lat, high lng,
    high lat); a cell at full depth stops whatever it holds, and is marked
    capped if that is too much. Points are counted once, in the deepest cells,
    and those counts are summed for all depths in one aggregation.
    """
    x0, y0, x1, y1 = box
    inside = points.where(F.col("lng").between(x0, x1) & F.col("lat").between(y0, y1))
    side = float(2**depth)
    at = lambda v, low, high: F.least(F.lit(side - 1), F.floor((F.col(v) - low) / (high - low) * side)).cast("long")
    deepest = inside.groupBy(at("lat", y0, y1).alias("_qy"), at("lng", x0, x1).alias("_qx")).agg(F.count(F.lit(1)).alias("_n"))
    # halving a side drops a bit of the place, since scaling by two is exact
    cells = deepest.select("*", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"))
    up = lambda c: F.expr(f"shiftright({c}, {depth} - depth)")
    n = cells.groupBy("depth", up("_qy").alias("qy"), up("_qx").alias("qx")).agg(F.sum("_n").alias("n"))
    full = n.where(F.col("n") > cap).select((F.col("depth") + 1).alias("depth"), F.col("qy").alias("_y"), F.col("qx").alias("_x"))
    above = n.withColumn("_y", F.when(F.col("depth") == 0, 0).otherwise(F.shiftright("qy", 1))).withColumn("_x", F.when(F.col("depth") == 0, 0).otherwise(F.shiftright("qx", 1)))
    stops = above.join(full, ["depth", "_y", "_x"], "left_semi").unionByName(above.where("depth = 0"))
    return stops.where((F.col("n") <= cap) | (F.col("depth") == depth)).select("depth", "qy", "qx", "n", (F.col("n") > cap).alias("capped"))
