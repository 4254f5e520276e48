"""Estimates of a later moment from an observation and its forecast, and their test against what came."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.timing import half_up_level, minutes_between
from tessera.operators.temporal import nearest_in_time
from tessera.operators.tracks import once
from tessera.params import NowcastGates
from tessera.scratch import written

MINUTE = 60_000_000


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def estimate(df: DataFrame, observed: str, target: str, pop: str, level: str, forecast: str, horizon_min: int = 720, gap_min: int = 90, nearest_min: int = 20) -> DataFrame:
    """Adds method, est_pop and est_level for target, from forecast, an array of (at, pop, level).

    Only forecasts after the observation and within the horizon count; a
    target before the observation or beyond the horizon, or without any such
    forecast, has the method none. A time that the forecast names twice with
    different values makes it invalid_forecast. exact: a forecast for target
    itself. interpolated: between the anchors around it, the observation
    among them, if they lie gap_min apart or less. nearest: the closest
    forecast, not the observation, within nearest_min, the earlier of two.
    """
    point = lambda x, t: F.struct(t.alias("t"), x.pop.cast("double").alias("pop"), x.level.cast("double").alias("level"))
    given = F.array_distinct(F.transform(F.coalesce(F.col(forecast), F.array()), lambda x: point(x, micros(x.at))))
    own = F.struct(micros(F.col(observed)).alias("t"), F.col(pop).cast("double").alias("pop"), F.col(level).cast("double").alias("level"))
    asked = F.struct(given.alias("given"), own.alias("own"), micros(F.col(target)).alias("t"))

    def anchors(x: Column) -> Column:
        ahead = F.array_sort(F.filter(x.given, lambda f: (f.t > x.own.t) & (f.t - x.own.t <= horizon_min * MINUTE)))
        twice = F.size(F.array_distinct(F.transform(x.given, lambda f: f.t))) < F.size(x.given)
        return F.struct(x.own.alias("own"), x.t.alias("t"), ahead.alias("ahead"), twice.alias("twice"))

    def places(x: Column) -> Column:
        every = F.concat(F.array(x.own), x.ahead)
        gap = lambda f: F.abs(f.t - x.t)
        close = F.array_min(F.transform(F.filter(x.ahead, lambda f: gap(f) <= nearest_min * MINUTE), lambda f: F.struct(gap(f).alias("g"), f.t.alias("t"), f.pop.alias("pop"), f.level.alias("level"))))
        return F.struct(
            x.own.t.alias("seen"),
            x.t.alias("t"),
            x.twice.alias("twice"),
            F.size(x.ahead).alias("n"),
            F.get(F.filter(x.ahead, lambda f: f.t == x.t), F.lit(0)).alias("exact"),
            F.try_element_at(F.filter(every, lambda f: f.t < x.t), F.lit(-1)).alias("before"),
            F.get(F.filter(every, lambda f: f.t > x.t), F.lit(0)).alias("after"),
            close.alias("close"),
        )

    def how(x: Column) -> Column:
        between = x.before.isNotNull() & x.after.isNotNull() & (x.after.t - x.before.t <= gap_min * MINUTE)
        inside = (x.t >= x.seen) & (x.t - x.seen <= horizon_min * MINUTE)
        return (
            F.when(~F.coalesce(inside, F.lit(False)), "none")
            .when(x.twice, "invalid_forecast")
            .when(x.n == 0, "none")
            .when(x.exact.isNotNull(), "exact")
            .when(between, "interpolated")
            .when(x.close.isNotNull(), "nearest")
            .otherwise("none")
        )

    def estimated(x: Column) -> Column:
        share = (x.p.t - x.p.before.t) / (x.p.after.t - x.p.before.t)

        def value(c: str) -> Column:
            a, b = x.p.before.getField(c), x.p.after.getField(c)
            return F.when(x.method == "exact", x.p.exact.getField(c)).when(x.method == "interpolated", a + (b - a) * share).when(x.method == "nearest", x.p.close.getField(c))

        return F.struct(x.method.alias("method"), value("pop").alias("pop"), half_up_level(value("level")).alias("level"))

    # every step stands once in the plan, however many columns ask for it
    found = once(once(once(asked, anchors), places), lambda p: F.struct(p.alias("p"), how(p).alias("method")))
    df = df.withColumn("_estimate", once(found, estimated))
    return df.withColumns({"method": F.col("_estimate.method"), "est_pop": F.col("_estimate.pop"), "est_level": F.col("_estimate.level")}).drop("_estimate")


def with_actual(estimated: DataFrame, actual: DataFrame, tolerance_min: float = 10.0) -> DataFrame:
    """Each estimate, with unique _id, observed_at, fetched_at and target, with the actual of its hotspot nearest to target.

    actual has hotspot_id, seen_at and seen_fetched_at and what else is
    wanted. It has to be observed and fetched after the estimate's own
    observation; equally near ones go by observation, then by fetch. Estimates
    without one are left out.
    """
    later = (F.col("seen_at") > F.col("observed_at")) & (F.col("seen_fetched_at") > F.col("fetched_at"))
    return nearest_in_time(estimated, actual, "hotspot_id", "target", "seen_at", tolerance_min, later, ["seen_fetched_at"])


def backtest(origins: DataFrame, actual: DataFrame, tolerance_min: float = 10.0, gates: NowcastGates = NowcastGates()) -> DataFrame:
    """One row: why origins were skipped, how estimates and persistence did, and which gates block.

    origins are estimated rows with _id, hotspot_id, observed_at, fetched_at,
    target, pop, level, forecast, method, est_pop and est_level; actual has
    hotspot_id, seen_at, seen_fetched_at, actual_pop and actual_level. A row
    is skipped for the first reason that holds, in the order of the columns.
    """
    reason = F.when(F.coalesce(F.size("forecast"), F.lit(0)) <= 0, "no_forecast").when(F.col("method") == "invalid_forecast", "invalid_forecast").when(F.col("method") == "none", "no_target_estimate")
    # written, as both what is skipped and what is judged come from it
    rows = written(origins.withColumn("_reason", reason))
    pairs = with_actual(rows.where("_reason IS NULL"), actual, tolerance_min)
    count = lambda r: F.count_if(F.col("_reason") == r).alias(f"skipped_{r}")
    asked = rows.agg(F.count(F.lit(1)).alias("origins"), *map(count, ["no_forecast", "invalid_forecast", "no_target_estimate"]))
    off = lambda c: F.abs(F.col(c) - F.col("actual_pop"))
    share = lambda ok: F.avg(ok.cast("double"))
    near = lambda c: F.abs(F.col(c) - F.col("actual_level")) <= 1
    done = pairs.agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_distinct("hotspot_id").alias("hotspots"),
        F.coalesce((F.max(micros(F.col("target"))) - F.min(micros(F.col("target")))) / (1440.0 * MINUTE), F.lit(0.0)).alias("span_days"),
        F.avg(minutes_between(F.col("fetched_at"), F.col("observed_at"))).alias("mean_lag_min"),
        F.try_divide(F.sum(off("est_pop")), F.sum("actual_pop")).alias("wape"),
        F.try_divide(F.sum(off("pop")), F.sum("actual_pop")).alias("persistence_wape"),
        F.avg(F.col("est_pop") - F.col("actual_pop")).alias("bias"),
        share(F.col("est_level") == F.col("actual_level")).alias("exact"),
        share(F.col("level") == F.col("actual_level")).alias("persistence_exact"),
        share(near("est_level")).alias("adjacent"),
        share(near("level")).alias("persistence_adjacent"),
    )
    out = asked.crossJoin(done)  # a row each
    out = out.withColumn("skipped_actual_outside_tolerance", F.col("origins") - F.col("skipped_no_forecast") - F.col("skipped_invalid_forecast") - F.col("skipped_no_target_estimate") - F.col("samples"))
    good = {
        "insufficient_samples": F.col("samples") >= gates.min_samples,
        "insufficient_hotspots": F.col("hotspots") >= gates.min_hotspots,
        "insufficient_span": F.col("span_days") >= gates.min_span_days,
        "population_wape_failed": F.col("wape") <= gates.max_wape,
        "population_regressed": F.col("wape") <= F.col("persistence_wape"),
        "level_exact_failed": F.col("exact") >= gates.min_exact,
        "level_exact_regressed": F.col("exact") >= F.col("persistence_exact"),
        "level_adjacent_failed": F.col("adjacent") >= gates.min_adjacent,
        "level_adjacent_regressed": F.col("adjacent") >= F.col("persistence_adjacent"),
    }
    blockers = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in good.items()]))
    return out.withColumn("blockers", blockers).withColumn("eligible", F.size("blockers") == 0)
