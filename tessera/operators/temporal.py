"""Latest, point-in-time and nearest-in-time lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.timing import minutes_between


def latest(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The row with the greatest at for each key; equal times go to the greatest tie."""
    order = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col(tie).desc())
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def as_of(asked: DataFrame, history: DataFrame, key: str, time: str, observed: str, fetched: str, tie: str, slice_hours: float = 24.0) -> DataFrame:
    """For each asked (key, time), the latest of history observed and fetched by then; unanswered rows stay.

    Both sides are merged into sequences instead of being joined by range: a
    row of history applies from the later of its two times, and the best so
    far runs along. A sequence is a key's in one slice of time; the best of
    each slice is carried over to those after it, so a key with a long history
    is spread over as many tasks as it has slices.
    """
    best = [c for c in history.columns if c != key]
    width = int(slice_hours * 3_600_000_000)
    known = history.where(F.col(observed).isNotNull() & F.col(fetched).isNotNull()).select(key, F.greatest(observed, fetched).alias("_t"), F.lit(0).alias("_q"), F.struct(F.col(observed).alias("_o"), F.col(tie).alias("_tie"), *best).alias("_row"), F.lit(None).cast(asked.schema[time].dataType).alias(time))
    wanted = asked.select(key, time).distinct().select(key, F.col(time).alias("_t"), F.lit(1).alias("_q"), F.lit(None).cast(known.schema["_row"].dataType).alias("_row"), time)
    merged = known.unionByName(wanted).withColumn("_slice", F.floor(F.unix_micros(F.col("_t").cast("timestamp")) / width))
    slices = merged.groupBy(key, "_slice").agg(F.max("_row").alias("_last"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select(key, "_slice", F.max("_last").over(before).alias("_carried"))
    run = Window.partitionBy(key, "_slice").orderBy("_t", "_q").rowsBetween(Window.unboundedPreceding, 0)
    inside = merged.withColumn("_best", F.max("_row").over(run)).where("_q = 1")
    met = inside.join(carried, [key, "_slice"]).withColumn("_best", F.greatest("_best", "_carried"))
    return met.select(key, time, *[F.col(f"_best.{c}").alias(c) for c in best])


def nearest_in_time(asked: DataFrame, actual: DataFrame, key: str, target: str, at: str, tolerance_min: float, allowed: Column | None = None, ties: list[str] | None = None) -> DataFrame:
    """Joins each asked row with the actual of its key nearest to target within the tolerance, the earlier of two.

    allowed says which pairs count; equal times go by the columns ties.

    Times are put into buckets as wide as the tolerance and met in the
    bucket itself and its neighbours. asked must have the unique column _id.
    """
    width = int(tolerance_min * 60_000_000)
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / width)
    a = asked.withColumn("_b", F.explode(F.array(*[bucket(target) + i for i in (-1, 0, 1)])))
    b = actual.withColumn("_b", bucket(at))
    gap = F.abs(minutes_between(F.col(at), F.col(target)))
    pairs = a.join(b, [key, "_b"]).withColumn("_gap", gap).where(F.col("_gap") <= tolerance_min)
    if allowed is not None:
        pairs = pairs.where(allowed)
    order = Window.partitionBy("_id").orderBy("_gap", at, *(ties or []))
    return pairs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_b", "_gap")


def running_cycle(snapshots: DataFrame, cycles: DataFrame, as_of: Column, longest_h: int = 48) -> DataFrame:
    """Each snapshot (event_id, fetched_at) with the latest cycle that was running when it was fetched, or null.

    A cycle without an end runs until as_of. Cycles meet snapshots by the
    hours that they touch; one that never closed would touch all hours, so
    beyond longest_h hours it counts as broken off.
    """
    hour = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / 3_600_000_000)
    end = F.least(F.coalesce(F.col("completed_at"), as_of), F.col("started_at") + F.expr(f"INTERVAL {longest_h} HOUR"))
    spans = cycles.withColumn("_end", end).where("_end >= started_at").select("cycle_id", "started_at", "_end", F.explode(F.sequence(hour(F.col("started_at")), hour(F.col("_end")))).alias("_h"))
    rows = snapshots.select("event_id", "fetched_at").withColumn("_h", hour(F.col("fetched_at")))
    met = rows.join(spans, "_h").where(F.col("fetched_at").between(F.col("started_at"), F.col("_end")))
    last = met.groupBy("event_id").agg(F.max_by("cycle_id", F.struct("started_at", "cycle_id")).alias("cycle_id"))
    return snapshots.select("event_id").join(last, "event_id", "left")
