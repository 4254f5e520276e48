"""The service report on ingest cycles: completeness, durations, gaps, delays, signals and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.timing import minutes_between
from tessera.operators.temporal import running_cycle

STATES = ("running", "complete", "partial", "failed")


def in_window(df: DataFrame, at: str, as_of: Column, hours: float) -> DataFrame:
    """Rows with at in the hours up to as_of, ends included."""
    age = minutes_between(as_of, F.col(at))
    return df.where((age >= 0) & (age <= hours * 60))


def distribution(value: Column, prefix: str) -> list[Column]:
    """Number, p50, p95 and greatest of a value without nulls, percentiles between the two next ranks."""
    return [F.count(value).alias(f"{prefix}_n"), F.percentile(value, F.lit(0.5)).alias(f"{prefix}_p50"), F.percentile(value, F.lit(0.95)).alias(f"{prefix}_p95"), F.max(value).alias(f"{prefix}_max")]


def starts(cycles: DataFrame, as_of: Column, hours: float) -> DataFrame:
    """(kind, since, until, gap_min): what lies between cycle starts, before the first and after the last, or the whole window without any.

    The table of cycles has a few rows for each hour of the window, so one
    task can order them.
    """
    begin = as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600.0))
    w = Window.orderBy("started_at", "cycle_id")
    inside = in_window(cycles, "started_at", as_of, hours).select("cycle_id", "started_at")
    between = inside.select(F.lit("between_cycles").alias("kind"), F.lag("started_at").over(w).alias("since"), F.col("started_at").alias("until")).where("since IS NOT NULL")
    ends = inside.agg(F.min("started_at").alias("first"), F.max("started_at").alias("last"))
    kind = lambda name, a, b: F.struct(F.lit(name).alias("kind"), a.alias("since"), b.alias("until"))
    some = F.array(kind("window_head", begin, F.col("first")), kind("window_tail", F.col("last"), as_of))
    edges = ends.select(F.inline(F.when(F.col("first").isNotNull(), some).otherwise(F.array(kind("empty_window", begin, as_of)))))
    rows = between.union(edges)
    return rows.withColumn("gap_min", F.greatest(F.lit(0.0), minutes_between(F.col("until"), F.col("since"))))


def gaps(cycles: DataFrame, as_of: Column, hours: float, cadence_min: float, factor: float = 2.0) -> DataFrame:
    """Gaps of factor times the expected cadence or more, with how many cycles they have probably missed: the nearest number of cadences in the gap less one."""
    found = starts(cycles, as_of, hours).where(F.col("gap_min") >= cadence_min * factor)
    return found.withColumn("missed", F.greatest(F.lit(0), F.floor(F.col("gap_min") / cadence_min + 0.5) - 1).cast("long"))


def signals(cycles: DataFrame, snapshots: DataFrame, as_of: Column, hours: float) -> DataFrame:
    """Each cycle of the window with the snapshots fetched while it ran, the latest started first, and what that signals.

    new_data with any; else duplicate_or_unchanged if it is complete, pending
    while it runs, and no_new_data_failure otherwise.
    """
    mine = in_window(cycles, "started_at", as_of, hours)
    seen = in_window(snapshots, "fetched_at", as_of, hours)
    n = running_cycle(seen, mine, as_of).where("cycle_id IS NOT NULL").groupBy("cycle_id").agg(F.count(F.lit(1)).alias("new_snapshots"))
    rows = mine.join(n, "cycle_id", "left").withColumn("new_snapshots", F.coalesce("new_snapshots", F.lit(0)))
    what = F.when(F.col("new_snapshots") > 0, "new_data").when(F.col("status") == "complete", "duplicate_or_unchanged").when(F.col("status") == "running", "pending").otherwise("no_new_data_failure")
    return rows.withColumn("signal", what)


def report(cycles: DataFrame, snapshots: DataFrame, hotspots: DataFrame, as_of: Column, hours: float = 24.0, cadence_min: float = 5.0, factor: float = 2.0) -> DataFrame:
    """One row about the hours up to as_of.

    cycles: cycle_id, started_at, completed_at, targets, saved, failed and
    status, one of STATES; snapshots: event_id, hotspot_id, observed_at,
    fetched_at; hotspots: hotspot_id, is_polled. Rates are over cycles that
    have ended. A cycle that ended without an end, or before it began, has no
    duration and is counted. Delays below zero are counted apart.
    """
    if hours <= 0 or cadence_min <= 0 or factor < 1:
        raise ValueError("the window and the cadence are positive, the factor is 1 at least")
    mine = in_window(cycles, "started_at", as_of, hours)
    polled = hotspots.where("is_polled").select("hotspot_id")
    seen = in_window(snapshots, "fetched_at", as_of, hours).join(polled, "hotspot_id", "left_semi")
    ended = F.col("status") != "running"
    seconds = 60.0 * minutes_between(F.col("completed_at"), F.col("started_at"))
    valid = ended & F.coalesce(seconds >= 0, F.lit(False))
    of_ended = lambda c: F.sum(F.when(ended, F.col(c)))
    parts = [
        mine.agg(
            F.count(F.lit(1)).alias("cycles"),
            F.count_if(ended).alias("terminal"),
            *[F.count_if(F.col("status") == s).alias(s) for s in STATES],
            F.try_divide(F.count_if(F.col("status") == "complete"), F.count_if(ended)).alias("complete_rate"),
            F.try_divide(of_ended("saved"), of_ended("targets")).alias("target_success_rate"),
            *distribution(F.when(valid, seconds), "seconds"),
            F.count_if(ended & ~valid).alias("invalid_durations"),
        ),
        starts(mine, as_of, hours).where("kind = 'between_cycles'").agg(*distribution(F.col("gap_min"), "interval_min")),
        gaps(mine, as_of, hours, cadence_min, factor).agg(F.count(F.lit(1)).alias("gaps"), F.coalesce(F.sum("missed"), F.lit(0)).alias("missed_cycles")),
    ]
    lag = minutes_between(F.col("fetched_at"), F.col("observed_at"))
    parts.append(seen.agg(*distribution(F.when(lag >= 0, lag), "lag_min"), F.count_if(lag < 0).alias("negative_lags")))
    told = signals(mine, seen, as_of, hours)
    parts.append(told.agg(*[F.count_if(F.col("signal") == s).alias(s) for s in ("new_data", "duplicate_or_unchanged", "pending", "no_new_data_failure")], F.count_if(ended & (F.col("status") != "complete")).alias("anomalous")))
    each = seen.groupBy("hotspot_id").agg(F.count(F.lit(1)).alias("n"))
    parts.append(polled.join(each, "hotspot_id", "left").agg(F.count(F.lit(1)).alias("polled"), F.count("n").alias("seen"), F.try_divide(F.count("n"), F.count(F.lit(1))).alias("coverage_rate"), *distribution(F.col("n"), "snapshots")))
    out = parts[0]
    for more in parts[1:]:
        out = out.crossJoin(more)  # a row each
    return out.withColumn("expected_cycles", F.lit(int(hours * 60 / cadence_min)))
