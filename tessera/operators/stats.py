"""Statistics that aggregate functions don't have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Adds the rank of value in its group, equal values sharing the mean of their ranks."""
    w = Window.partitionBy(*group)
    rank = F.rank().over(w.orderBy(value))
    return df.withColumn(name, rank + (F.count(F.lit(1)).over(Window.partitionBy(*group, value)) - 1) / 2.0)


def pearson(x: Column, y: Column) -> Column:
    """From sums; null with fewer than two rows or without variance."""
    n = F.count(F.lit(1)).cast("double")
    sxy, sx, sy, sxx, syy = F.sum(x * y), F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y)
    spread = (n * sxx - sx * sx) * (n * syy - sy * sy)
    return F.when(spread > 0, (n * sxy - sx * sy) / F.sqrt(spread))


def spearman(df: DataFrame, group: list[str], x: str, y: str, least: int = 2) -> DataFrame:
    """Rows (group, n, rho): rank correlation with average ranks; null under least rows or for constants."""
    ranked = average_rank(average_rank(df, group, x, "_rx"), group, y, "_ry")
    out = ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), pearson(F.col("_rx"), F.col("_ry")).alias("rho"))
    return out.withColumn("rho", F.when(F.col("n") >= least, F.col("rho")))


def weighted_kappa(df: DataFrame, group: list[str], a: str, b: str, levels: int = 4) -> DataFrame:
    """Quadratically weighted agreement; null under two rows or if a rater uses one level."""
    w = lambda x, y: 1.0 - F.pow((x - y) / (levels - 1.0), 2.0)
    cells = df.groupBy(*group, a, b).agg(F.count(F.lit(1)).alias("_n"))
    side = lambda c: cells.groupBy(*group, c).agg(F.sum("_n").alias(f"_n{c}"))
    expected = side(a).join(side(b), group).groupBy(*group).agg(F.sum(F.col(f"_n{a}") * F.col(f"_n{b}") * w(F.col(a), F.col(b))).alias("_e"))
    seen = cells.groupBy(*group).agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * w(F.col(a), F.col(b))).alias("_o"), F.count_distinct(a).alias("_da"), F.count_distinct(b).alias("_db"))
    po, pe = F.col("_o") / F.col("n"), F.col("_e") / (F.col("n") * F.col("n"))
    value = F.when((F.col("n") >= 2) & (F.col("_da") > 1) & (F.col("_db") > 1) & (pe < 1), (po - pe) / (1.0 - pe))
    return seen.join(expected, group).select(*group, "n", value.alias("kappa"))


def weighted_stats(w: Column, x: Column, around: Column | float = 0.0) -> tuple[Column, Column, Column]:
    """Mean, variance and effective number (the squared sum of weights by the sum of squares).

    Squares are of the distance to around, the same for all rows of a group; a
    value near the mean keeps the variance's digits where it is small against
    the mean.
    """
    d = x - around
    off = F.sum(w * d) / F.sum(w)
    mean = F.sum(w * x) / F.sum(w)
    var = F.greatest(F.lit(0.0), F.sum(w * d * d) / F.sum(w) - off * off)
    return mean, var, F.sum(w) * F.sum(w) / F.sum(w * w)


def js_distance(df: DataFrame, group: list[str], p: str, q: str) -> DataFrame:
    """Jensen-Shannon distance of two distributions over each group's rows, by base 2; null if one has no mass."""
    w = Window.partitionBy(*group)
    a, b = F.try_divide(F.col(p), F.sum(p).over(w)), F.try_divide(F.col(q), F.sum(q).over(w))
    rows = df.select(*group, a.alias("_a"), b.alias("_b")).withColumn("_m", (F.col("_a") + F.col("_b")) / 2.0)
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / F.col("_m"))).when(F.col(c) == 0, 0.0)
    return rows.groupBy(*group).agg(F.sqrt(F.when(F.sum(part("_a") + part("_b")) < 0, 0.0).otherwise(F.sum(part("_a") + part("_b")) / 2.0)).alias("js_distance"))
