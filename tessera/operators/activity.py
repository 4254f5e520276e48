"""Activity estimates from contributors: anomalies against their baselines, with evidence, or the reason for none."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.timing import minutes_between

# Kinds of observations and modes.
TYPES = ("presence_count", "pedestrian_flow", "venue_popularity", "transit_flow", "proxy")
MODES = ("baseline_only", "observed", "forecast", "unsupported")


@dataclass(frozen=True)
class Activity:
    cap: float = 5.0
    least_dispersion: float = 1e-6
    stale_min: float = 25.0
    skew_min: float = 2.0


def reference_faults(r: Column) -> dict[str, Column]:
    """What a baseline's reference may break: a struct of versions, source_hashes, window, cutoff, bucket and numbers."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    return {
        "reference_text": blank(r.model_version) | blank(r.source_version) | blank(r.calendar_version) | blank(r.selected_bucket),
        "reference_hashes": (F.size(F.coalesce(r.source_hashes, F.array())) <= 0) | F.exists(F.coalesce(r.source_hashes, F.array()), blank),
        "reference_window": ~F.coalesce(r.window_start < r.window_end, F.lit(False)),
        "reference_cutoff": ~F.coalesce(r.cutoff == r.window_end, F.lit(False)),
        "reference_raw_n": ~F.coalesce(r.raw_n > 0, F.lit(False)),
        "reference_effective_n": ~F.coalesce((r.effective_n > 0) & (r.effective_n <= r.raw_n), F.lit(False)),
        "reference_depth": ~F.coalesce(r.fallback_depth >= 0, F.lit(False)),
        "reference_masked_share": ~F.coalesce(r.masked_share.between(0, 1), F.lit(False)),
    }


def finite(c: Column) -> Column:
    return F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False))


def contributor_faults(now: Column, p: Activity) -> dict[str, Column]:
    """What a contributor may break, by name, in the order in which it is told."""
    c = F.col
    amount = lambda x: finite(x) & (x >= 0)
    unit = lambda x: F.coalesce(x.between(0, 1), F.lit(False))
    blank = lambda x: F.coalesce(F.trim(x) == "", F.lit(True))
    point, low, high = c("value").isNotNull(), c("value_min").isNotNull(), c("value_max").isNotNull()
    some = point | low
    seen, got = c("observed_at"), c("fetched_at")
    after = lambda a, b: F.coalesce(minutes_between(a, b) > p.skew_min, F.lit(False))
    current = c("mode").isin("observed", "forecast")
    return {
        "contributor_id": blank(c("contributor_id")),
        "baseline_mean": ~amount(c("baseline_mean")),
        **reference_faults(c("reference")),
        "dispersion": c("baseline_dispersion").isNotNull() & ~amount(c("baseline_dispersion")),
        "weight": ~(finite(c("weight")) & (c("weight") > 0)),
        "freshness_score": ~unit(c("freshness_score")),
        "quality": ~unit(c("quality")),
        "provenance": blank(c("source_id")) | blank(c("source_version")) | blank(c("geometry")) | blank(c("provenance")),
        "fetched_at": got.isNull(),
        "fetched_in_the_future": after(got, now),
        "value_and_interval": point & (low | high),
        "half_an_interval": low != high,
        "value": (point & ~amount(c("value"))) | (low & ~amount(c("value_min"))) | (high & ~amount(c("value_max"))),
        "interval_order": F.coalesce(c("value_min") > c("value_max"), F.lit(False)),
        "baseline_only_with_observation": (c("mode") == "baseline_only") & (some | seen.isNotNull()),
        "no_observation": current & (~some | seen.isNull()),
        "observed_in_the_future": (c("mode") == "observed") & after(seen, now),
        "observed_after_fetch": (c("mode") == "observed") & F.coalesce(seen > got, F.lit(False)),
        "forecast_expired": (c("mode") == "forecast") & after(now, seen),
        "forecast_before_fetch": (c("mode") == "forecast") & after(got, seen),
        "cutoff_after_observation": current & F.coalesce(c("reference").cutoff > F.to_date(seen), F.lit(False)),
    }


def first_of(faults: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in faults.items()])


def estimates(contributors: DataFrame, now: Column, p: Activity = Activity()) -> DataFrame:
    """A row for each estimate_id of contributors, with the anomaly or with error, the name of the first thing that is wrong.

    contributors: estimate_id, observation_type, mode, contributor_id,
    source_id, source_version, geometry, provenance, value or value_min and
    value_max, baseline_mean, baseline_dispersion (null if unknown), weight,
    freshness_score, quality, observed_at, fetched_at and reference.

    Anomalies are differences of log1p, weighted; standardized ones are divided
    by the dispersion within the cap, null if a contributor has none to speak
    of. disagreement is the weighted deviation of the intervals' middles.
    Observations, or forecasts by their fetch, older than stale_min make an
    estimate stale, which then has evidence but no anomaly; fresh and stale
    ones can't be mixed. Contributors of different types, sources or
    versions don't combine, nor do two of one id. Raw values and baselines
    show for a single contributor alone. evidence holds each contributor with
    its part, in order of its id.
    """
    c = F.col
    own = first_of(contributor_faults(now, p))
    low, high = F.coalesce("value", "value_min"), F.coalesce("value", "value_max")
    age = F.when(c("mode") == "observed", minutes_between(now, c("observed_at"))).when(c("mode") == "forecast", minutes_between(now, c("fetched_at")))
    rows = contributors.withColumns({"_fault": own, "_stale": age > p.stale_min, "_low": low, "_high": high})
    base = F.log1p("baseline_mean")
    rows = rows.withColumns({"_a": F.log1p("_low") - base, "_b": F.log1p("_high") - base})
    clip = lambda x: F.greatest(F.lit(-p.cap), F.least(F.lit(p.cap), x))
    known = c("baseline_dispersion") >= p.least_dispersion
    rows = rows.withColumns({"_sa": F.when(known, clip(F.try_divide("_a", "baseline_dispersion"))), "_sb": F.when(known, clip(F.try_divide("_b", "baseline_dispersion"))), "_mid": (c("_a") + c("_b")) / 2.0})
    mean = lambda x: F.try_divide(F.sum(c("weight") * c(x)), F.sum("weight"))
    one = lambda x: F.when(F.count(F.lit(1)) == 1, F.first(x))
    unlike = lambda x: F.count_distinct(x) > 1
    evidence = F.struct("contributor_id", "weight", "baseline_mean", "_low", "_high", "_a", "_b", "_sa", "_sb", "_mid", "observed_at", "fetched_at")
    made = rows.groupBy("estimate_id").agg(
        F.first("mode").alias("mode"),
        F.first("observation_type").alias("observation_type"),
        F.first("source_id").alias("source_id"),
        F.first("source_version").alias("source_version"),
        F.count(F.lit(1)).alias("n"),
        F.min_by("_fault", F.when(c("_fault").isNotNull(), F.struct("contributor_id", "source_id", "geometry", "provenance"))).alias("_own"),
        F.count_if(~F.coalesce(c("mode").isin(*MODES), F.lit(False)) | ~F.coalesce(c("observation_type").isin(*TYPES), F.lit(False))).alias("_odd"),
        unlike("mode").alias("_modes"),
        unlike("observation_type").alias("_types"),
        unlike("source_id").alias("_sources"),
        unlike("source_version").alias("_versions"),
        (F.count_distinct("contributor_id") < F.count("contributor_id")).alias("_twice"),
        F.count_if("_stale").alias("_stale"),
        one("baseline_mean").alias("baseline_mean"),
        one("_low").alias("_low"),
        one("_high").alias("_high"),
        *[mean(f"_{x}").alias(x) for x in ("a", "b", "mid")],
        *[F.when(F.count(f"_{x}") == F.count(F.lit(1)), mean(f"_{x}")).alias(x) for x in ("sa", "sb")],
        mean("freshness_score").alias("freshness_score"),
        mean("quality").alias("quality"),
        F.sum("weight").alias("_weight"),
        F.min("observed_at").alias("observed_at_min"),
        F.max("observed_at").alias("observed_at_max"),
        F.max("fetched_at").alias("fetched_at_max"),
        F.sort_array(F.collect_list(evidence)).alias("_e"),
    )
    error = F.coalesce(
        F.when(c("_odd") > 0, "type_or_mode"),
        F.when(c("_modes"), "different_modes"),
        F.when(c("mode") == "unsupported", "unsupported_with_contributors"),
        F.when(c("_twice"), "duplicate_contributor_id"),
        F.when(c("_sources"), "different_sources"),
        F.when(c("_versions"), "different_versions"),
        F.when(c("_types"), "different_types"),
        c("_own"),
        F.when((c("_stale") > 0) & (c("_stale") < c("n")), "fresh_and_stale"),
    )
    made = made.withColumn("error", error)
    good = c("error").isNull()
    stale = c("_stale") > 0
    fresh = F.when(c("mode") == "baseline_only", "n/a").when(stale, "stale").otherwise("fresh")
    active = good & c("mode").isin("observed", "forecast") & ~stale
    only = lambda x: F.when(active, x)
    same = lambda x, y: F.when(active & (x == y), x)
    # around the weighted middle, so that no digits are lost
    spread = F.aggregate("_e", F.lit(0.0), lambda acc, e: acc + e.weight * (e._mid - c("mid")) * (e._mid - c("mid")))
    shown = lambda e: F.struct(e.contributor_id.alias("contributor_id"), e.weight.alias("weight"), F.try_divide(e.weight, c("_weight")).alias("normalized_weight"), e.baseline_mean.alias("baseline_mean"), only(e._a).alias("anomaly_min"), only(e._b).alias("anomaly_max"), only(e._sa).alias("standardized_min"), only(e._sb).alias("standardized_max"), e.observed_at.alias("observed_at"), e.fetched_at.alias("fetched_at"))
    ok = lambda x: F.when(good, x)
    return made.select(
        "estimate_id",
        "error",
        "mode",
        "observation_type",
        ok(c("source_id")).alias("source_id"),
        ok(c("source_version")).alias("source_version"),
        ok(fresh).alias("freshness"),
        "n",
        ok(c("baseline_mean")).alias("baseline_mean"),
        same(c("_low"), c("_high")).alias("current_value"),
        only(c("_low")).alias("current_min"),
        only(c("_high")).alias("current_max"),
        same(c("a"), c("b")).alias("anomaly"),
        only(c("a")).alias("anomaly_min"),
        only(c("b")).alias("anomaly_max"),
        same(c("sa"), c("sb")).alias("standardized"),
        only(c("sa")).alias("standardized_min"),
        only(c("sb")).alias("standardized_max"),
        only(F.sqrt(F.try_divide(spread, c("_weight")))).alias("disagreement"),
        ok(c("observed_at_min")).alias("observed_at_min"),
        ok(c("observed_at_max")).alias("observed_at_max"),
        ok(c("fetched_at_max")).alias("fetched_at_max"),
        ok(c("freshness_score")).alias("freshness_score"),
        ok(c("quality")).alias("quality"),
        ok(F.transform("_e", shown)).alias("evidence"),
    )
