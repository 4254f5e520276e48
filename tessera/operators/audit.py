"""Checks, comparisons and summaries of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_flags(df: DataFrame, flags: Mapping[str, Column], total: str | None = "n") -> DataFrame:
    """One row: the number of rows and, for each flag, of those where it holds."""
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in flags.items()]
    return df.agg(*([F.count(F.lit(1)).alias(total)] if total else []), *counts)


def violations(checks: Sequence[tuple[str, DataFrame, Column]]) -> DataFrame:
    """(rule, n) for each (rule, table, condition): rows for which it doesn't hold, null included."""
    out = None
    for name, df, ok in checks:
        one = df.agg(F.count_if(~F.coalesce(ok, F.lit(False))).alias("n")).select(F.lit(name).alias("rule"), "n")
        out = one if out is None else out.union(one)
    return out


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of several rows, with their number n."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(df: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose key no parent has."""
    return df.join(parents.select(key).distinct(), key, "left_anti")


def key_sides(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every key of either table once, a null one too, and whether it stands in the left, the right or both."""
    mark = lambda df, n: df.select(F.col(key).alias("_key"), F.lit(n).alias("_side"))
    seen = mark(left, 1).union(mark(right, 2)).groupBy("_key").agg(F.bit_or("_side").alias("_sides"))
    return seen.select(F.col("_key").alias(key), F.when(F.col("_sides") == 1, "left").when(F.col("_sides") == 2, "right").otherwise("both").alias("side"))


def complete_keys(df: DataFrame, key: str, part: str, wanted: Sequence[int]) -> DataFrame:
    """Keys that have rows for all parts wanted."""
    return df.where(F.col(part).isin(*wanted)).groupBy(key).agg(F.count_distinct(part).alias("_n")).where(F.col("_n") == len(set(wanted))).select(key)


def paired(before: DataFrame, after: DataFrame, key: str, value: str, absent: float = 0.0) -> DataFrame:
    """Both sides' sums of value by key, an absent side as given, and the change."""
    a = before.groupBy(key).agg(F.sum(value).alias("_a"))
    b = after.groupBy(key).agg(F.sum(value).alias("_b"))
    both = a.join(b, key, "full").na.fill(absent, ["_a", "_b"])
    return both.select(key, F.col("_a").alias(f"before_{value}"), F.col("_b").alias(f"after_{value}"), (F.col("_b") - F.col("_a")).alias("change"))


def top_share(df: DataFrame, group: str, key: str, value: str, share: float) -> DataFrame:
    """Of each group, the keys with the greatest values: that share of them, rounded up; ties go by key."""
    w = Window.partitionBy(group)
    ranked = df.withColumn("_n", F.row_number().over(w.orderBy(F.desc(value), key))).withColumn("_k", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("_n") <= F.ceil(F.col("_k") * F.lit(share))).select(group, key)


def jaccard(sets: DataFrame, group: str, key: str) -> DataFrame:
    """One row for two sets, which group tells apart: the keys in either, in both, and the share of the latter."""
    n = sets.groupBy(key).agg(F.count_distinct(group).alias("_n"))
    return n.agg(F.count(F.lit(1)).alias("either"), F.count_if(F.col("_n") == 2).alias("both")).withColumn("jaccard", F.try_divide("both", "either"))


def day_pairs(df: DataFrame, key: str, day: str, days: int) -> DataFrame:
    """(key, first_date, second_date) for days with rows that lie that many days apart; an equality join."""
    held = df.select(key, day).distinct()
    later = held.select(key, F.date_sub(day, days).alias("first_date"), F.col(day).alias("second_date"))
    return held.withColumnRenamed(day, "first_date").join(later, [key, "first_date"])


def mask_states(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: groups, those of several fragments, partly and wholly masked ones, and the largest number of fragments."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("masked").alias("m"))
    return g.agg(F.count(F.lit(1)).alias("cell_hours"), F.count_if(F.col("n") > 1).alias("multi"), F.count_if((F.col("m") > 0) & (F.col("m") < F.col("n"))).alias("partial_masked"), F.count_if(F.col("m") == F.col("n")).alias("all_masked"), F.max("n").alias("most"))


def owner_conflicts(df: DataFrame, value: str, owner: str) -> DataFrame:
    """Values that several owners claim, and how many."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_distinct(owner).alias("owners")).where("owners > 1")


def matrix(df: DataFrame, rows: DataFrame, columns: Sequence[str], row: str, column: str) -> DataFrame:
    """Counts for every pair of a row and a column value, zeros included."""
    every = rows.select(row).distinct().withColumn(column, F.explode(F.array(*map(F.lit, columns))))
    seen = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    return every.join(seen, [row, column], "left").na.fill(0, ["n"])


def field_conflicts(df: DataFrame, key: str, fields: Sequence[str], mark: str = "") -> DataFrame:
    """Keys of several rows, n, and for each field name_conflict: its name if the rows disagree; a null counts as mark."""
    flag = lambda c: F.when(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(mark))) > 1, c).alias(f"{c}_conflict")
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *map(flag, fields)).where("n > 1")


def exact_repeats(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row: all rows, and how many of them repeat another in the fields."""
    print_ = F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).cast("binary"), 256)
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(print_).alias("_d")).select("n", (F.col("n") - F.col("_d")).alias("duplicates"))


def turns(df: DataFrame, group: str, order: Sequence[str], of: int) -> Column:
    """The place of a row in its group, counted again from 0 after so many."""
    return ((F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1) % of).cast("int")


def nearest_rank(value: str, share: float) -> Column:
    """The percentile that is one of the values: that of rank ceil(share * n)."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})")


def number_profile(df: DataFrame, value: str, extreme: float) -> DataFrame:
    """One row: zeros, negatives, extremes and bounds of a number column."""
    v = F.col(value)
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(v == 0).alias("zeros"), F.count_if(v < 0).alias("negatives"), F.count_if(v > extreme).alias("extremes"), F.min(v).alias("least"), F.max(v).alias("most"))


def rule_counts(df: DataFrame, rules: Mapping[str, str], table: str) -> DataFrame:
    """(table, rule, n): how many rows don't meet each rule, a condition in SQL; null is no violation, as in constraints."""
    counts = df.agg(*[F.count_if(~F.coalesce(F.expr(text), F.lit(True))).alias(name) for name, text in rules.items()])
    items = F.array(*[F.struct(F.lit(table).alias("table"), F.lit(name).alias("rule"), F.col(name).alias("n")) for name in rules])
    return counts.select(F.inline(items))


def strata_metrics(pairs: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Errors of value against actual and level against actual_level: in all, by each of strata, and by all of them.

    Columns: strata (null where a row is about all of them), stratum (the
    names that it is by), n, mae, wape, bias, exact and adjacent.
    """
    gap = F.col("value") - F.col("actual")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    metrics = [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(gap)).alias("mae"),
        F.when(F.sum("actual") > 0, F.sum(F.abs(gap)) / F.sum("actual")).alias("wape"),
        F.avg(gap).alias("bias"),
        share(F.col("level") == F.col("actual_level")).alias("exact"),
        share(F.abs(F.col("level") - F.col("actual_level")) <= 1).alias("adjacent"),
    ]
    by = F.concat_ws("+", *[F.when(F.grouping(s) == 0, s) for s in strata]).alias("stratum")
    return pairs.cube(*strata).agg(by, *metrics)


def refresh_plan(old: DataFrame, new: DataFrame, key: str, changes: Mapping[str, Column], moved: Column, large_m: float = 80.0) -> DataFrame:
    """One row: rows in both tables, changed and unchanged ones, by kind of change, large moves, and keys of one table alone."""
    sides = key_sides(old, new, key).agg(F.count_if(F.col("side") == "left").alias("missing"), F.count_if(F.col("side") == "right").alias("added"))
    hit = F.lit(False)
    for c in changes.values():
        hit = hit | F.coalesce(c, F.lit(False))
    rows = old.join(new, key)
    plan = rows.agg(F.count(F.lit(1)).alias("matched"), F.count_if(hit).alias("changed"), F.count_if(~hit).alias("unchanged"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in changes.items()], F.count_if(moved > large_m).alias("large_moves"))
    return plan.crossJoin(sides)  # a row each


def top_moves(rows: DataFrame, moved: Column, key: str, n: int = 20) -> DataFrame:
    """The n rows that moved farthest, ties by key."""
    return rows.withColumn("moved_m", moved).where("moved_m IS NOT NULL").orderBy(F.desc("moved_m"), key).limit(n)


def best_by_band(rows: DataFrame, group: str, band: str, order: Sequence[Column], per_band: int) -> DataFrame:
    """Adds place, and keeps the first per_band rows of each group and band."""
    w = Window.partitionBy(group, band).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_band)


def shortages(chosen: DataFrame, groups: DataFrame, group: str, band: str, bands: Sequence[str], per_band: int) -> DataFrame:
    """(group, band, found, wanted) where a group's band has fewer rows than wanted, none included."""
    counts = matrix(chosen, groups, bands, group, band)
    return counts.where(F.col("n") < per_band).select(group, band, F.col("n").alias("found"), F.lit(per_band).alias("wanted"))


def angle_gap(a: Column, b: Column) -> Column:
    """Degrees between two bearings, 180 at most."""
    gap = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(gap, 360.0 - gap)


def outcome(a: Column, b: Column, margin: float = 1e-9) -> Column:
    """win where a is the smaller error, loss where b is, tie within the margin."""
    return F.when(F.abs(a - b) <= margin, "tie").when(a < b, "win").otherwise("loss")


def differs(a: Column, b: Column, within: float | None = None) -> Column:
    """Whether two values differ: numbers by more than a tolerance, else anything, where null equals null."""
    if within is None:
        return ~a.eqNullSafe(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) > within).otherwise(a.isNotNull() | b.isNotNull())


def link_of(has_row: Column, row_link: Column, other: Column, active: Column) -> Column:
    """The provider row's link before another one; a row that isn't active leaves none."""
    return F.when(has_row & active, row_link).when(~has_row, other)


def undirected(a: Column, b: Column) -> tuple[Column, Column]:
    """A segment's two ends, the smaller first."""
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")
