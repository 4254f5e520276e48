"""Fragments, flow artefacts, service reports, activity and evaluation as of each truth."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import activity, audit, baseline, evaluation, fragments, od_report, slo
from tessera.operators.spatial import nearest_at
from tessera.plans.registry import stored
from tessera.plans.scores import delay_pairs, now, observations, scores
from tessera.scratch import scratch_path
from tessera.sources.adapters import load
from tessera.streaming.rescore import Rescorer


def cells(spark, sf_dir):
    rows = load(spark, sf_dir, "population_rows")
    allowed = rows.select("cell_id").distinct().where("substr(cell_id, 3, 4) <> '0000'")
    return fragments.compact(rows, allowed)


@stored
def fragment_cells(spark, sf_dir):
    """Counts by cell and hour with their fragments as canonical JSON."""
    return cells(spark, sf_dir).withColumn("known_total", F.col("known_total").cast("string"))


@stored
def fragment_faults(spark, sf_dir):
    """Compacted rows of which some are spoilt, with the names of what is wrong."""
    kind = (F.substring("cell_id", 3, 4).cast("int") / 25 + F.col("hour") + F.day("date")) % 9
    spoilt = cells(spark, sf_dir).withColumn("_kind", kind)
    change = lambda k, c, v: F.when(F.col("_kind") == k, v).otherwise(F.col(c))
    text = F.when(F.col("_kind") == 3, F.concat("fragments_json", F.lit(" "))).when(F.col("_kind") == 4, F.lit("{")).otherwise(F.col("fragments_json"))
    spoilt = spoilt.withColumns({"known_total": change(1, "known_total", (F.col("known_total") + 1).cast(fragments.DECIMAL)), "fragment_count": change(2, "fragment_count", F.col("fragment_count") + 1), "fragments_json": text})
    return fragments.verify(spoilt).select("date", "hour", "cell_id", F.array_join("faults", ",").alias("faults"))


@stored
def row_faults(spark, sf_dir):
    """Raw rows spoilt in several ways, counted before any cell is chosen."""
    rows = load(spark, sf_dir, "population_rows")
    total = F.when(F.col("total_raw") == "*", "x").otherwise(F.concat("total_raw", F.lit("0001")))
    cell = F.when(F.substring("cell_id", 3, 4) == "0025", F.concat(F.substring("cell_id", 1, 2), F.lit("00240025"))).otherwise(F.col("cell_id"))
    hour = F.when(F.col("hour_raw") == "03", "24").otherwise(F.col("hour_raw"))
    return fragments.count_faults(rows.withColumns({"total_raw": total, "cell_id": cell, "hour_raw": hour}))


HOURS = (8, 14)


def flows_of_day(spark, sf_dir):
    moves = load(spark, sf_dir, "moves_of_day")
    return moves, od_report.selected(moves, date(2024, 1, 9), HOURS), load(spark, sf_dir, "od_centroids")


@stored
def od_artifact(spark, sf_dir):
    """Movements of two hours of a day, by zone; purposes in thousandths and millionths."""
    _, flows, places = flows_of_day(spark, sf_dir)
    made = od_report.movements(flows, places, HOURS)
    whole = lambda c, k: F.round(c * k).cast("long").cast("string")
    text = F.array_join(F.transform("purposes", lambda x: F.concat_ws(":", x.purpose.cast("string"), whole(x["count"], 1000), whole(x.ratio, 1000000))), ",")
    shown = ["zone_id", "name", "hour", "local_time", "inbound", "outbound", "net", "intrazonal_inbound", "intrazonal_outbound", "mean_distance_m", "mean_duration_min", "placed_rows", "total_rows", "placed_ratio", "direction_coverage"]
    return made.select(*shown, text.alias("purposes"), F.col("centroid.lat").alias("lat"), F.round("strength", 6).alias("strength"), F.round("heading_deg", 3).alias("heading_deg"))


@stored
def od_artifact_coverage(spark, sf_dir):
    """How much of the artefact's flow has places."""
    moves, flows, places = flows_of_day(spark, sf_dir)
    scanned = moves.agg(F.count(F.lit(1)).alias("n"))
    made = od_report.coverage(flows, F.lit(0), places).drop("rows_scanned", "placed_flow", "intrazonal_flow", "zone_ratio").crossJoin(scanned.select(F.col("n").alias("rows_scanned")))  # a row each
    codes = lambda c: F.array_join(F.array_sort(F.col(c).cast("array<string>")), ",").alias(c)
    return made.select(*(c for c in made.columns if not c.startswith("missing")), codes("missing_origins"), codes("missing_destinations"))


WINDOW = {"hours": 400.0, "cadence_min": 45.0, "factor": 1.5}


def service(spark, sf_dir):
    return load(spark, sf_dir, "cycle_states"), load(spark, sf_dir, "snapshots"), load(spark, sf_dir, "hotspots")


@stored
def ingest_slo(spark, sf_dir):
    """The service report on the last 400 hours."""
    made = slo.report(*service(spark, sf_dir), now(), **WINDOW)
    rounded = {c: 9 for c in ("complete_rate", "target_success_rate", "coverage_rate")} | {c: 6 for c in ("interval_min_p50", "interval_min_max", "lag_min_p95", "snapshots_p50")} | {c: 3 for c in ("seconds_p50", "seconds_p95")}
    counts = ["cycles", "terminal", "complete", "partial", "failed", "seconds_n", "invalid_durations", "interval_min_n", "gaps", "missed_cycles", "negative_lags", "new_data", "duplicate_or_unchanged", "no_new_data_failure", "anomalous", "polled", "seen", "expected_cycles"]
    return made.select(*counts, *[F.round(c, n).alias(c) for c, n in rounded.items()])


@stored
def slo_gaps(spark, sf_dir):
    """Gaps between cycles, before the first and after the last."""
    return slo.gaps(load(spark, sf_dir, "cycle_states"), now(), **WINDOW).withColumn("gap_min", F.round("gap_min", 6))


@stored
def cycle_signals(spark, sf_dir):
    """What each cycle brought."""
    cycles, snapshots, hotspots = service(spark, sf_dir)
    polled = snapshots.join(hotspots.where("is_polled").select("hotspot_id"), "hotspot_id", "left_semi")
    return slo.signals(cycles, polled, now(), WINDOW["hours"]).select("cycle_id", "status", "new_snapshots", "signal")


@stored
def activity_estimates(spark, sf_dir):
    """Cafes' activity from the intervals of up to three hotspots, some of which have faults."""
    seen = observations(spark, sf_dir)
    cafes = load(spark, sf_dir, "cafes").select("cafe_id", "lat", "lng")
    near = nearest_at(cafes, seen, "hotspot_id", 1500.0, 3)
    log = F.ln(1 + F.col("ppltn_min").cast("double"))
    base = load(spark, sf_dir, "snapshots").groupBy("hotspot_id").agg(F.avg("ppltn_min").alias("baseline_mean"), F.stddev_pop(log).alias("_s"))
    base = base.withColumn("baseline_dispersion", F.when(F.col("hotspot_id") % 9 != 0, F.col("_s"))).drop("_s")
    day = F.lit("2023-12-01").cast("date")
    reference = F.struct(
        *[F.lit("v1").alias(c) for c in ("model_version", "source_version", "calendar_version", "selected_bucket")],
        F.array(F.lit("hash")).alias("source_hashes"),
        F.date_sub(day, 84).alias("window_start"),
        day.alias("window_end"),
        day.alias("cutoff"),
        F.when(F.col("hotspot_id") % 41 == 0, 0).otherwise(9).alias("raw_n"),
        F.lit(3.5).alias("effective_n"),
        F.lit(0).alias("fallback_depth"),
        F.lit(0.0).alias("masked_share"),
    )
    weight = F.when(F.col("hotspot_id") % 37 == 0, 0.0).otherwise(1.0 / F.pow(F.greatest(F.col("distance_m"), F.lit(50.0)), 2.0))
    text = {"observation_type": "presence_count", "mode": "observed", "source_id": "s", "source_version": "v", "geometry": "point", "provenance": "p"}
    rows = near.join(base, "hotspot_id").select(
        F.struct("lat", "lng").alias("estimate_id"),  # cafes at one spot share an estimate
        *[F.lit(v).alias(k) for k, v in text.items()],
        F.col("hotspot_id").cast("string").alias("contributor_id"),
        F.lit(None).cast("double").alias("value"),
        F.col("ppltn_min").cast("double").alias("value_min"),
        F.col("ppltn_max").cast("double").alias("value_max"),
        "baseline_mean",
        "baseline_dispersion",
        weight.alias("weight"),
        F.lit(1.0).alias("freshness_score"),
        F.lit(1.0).alias("quality"),
        "observed_at",
        "fetched_at",
        reference.alias("reference"),
    )
    made = activity.estimates(rows, now(), activity.Activity(stale_min=720.0))
    digits = {"baseline_mean": 6, "anomaly_min": 7, "anomaly_max": 7, "standardized_min": 6, "disagreement": 6}
    made = made.select("estimate_id.*", "error", "n", "freshness", "current_min", *[F.round(c, n).alias(c) for c, n in digits.items()])
    return cafes.join(made, ["lat", "lng"]).withColumnRenamed("cafe_id", "estimate_id").drop("lat", "lng")


def scores_then(spark, sf_dir, **args):
    return evaluation.scores_as_of(load(spark, sf_dir, "truths"), *(load(spark, sf_dir, t) for t in ("cafes", "hotspots", "snapshots")), **args)


def points_then(spark, sf_dir, **args):
    truths = load(spark, sf_dir, "truths").withColumnRenamed("observed_area_level", "truth")
    return evaluation.evaluated(truths, scores_then(spark, sf_dir, **args))


@stored
def scores_as_of(spark, sf_dir):
    """The score of each cafe at the time of each observation in the field."""
    made = scores_then(spark, sf_dir)
    return made.select("cafe_id", "observed_at", F.round("score", 6).alias("score"), F.when(F.col("score").isNotNull(), F.col("level")).alias("level"), "coverage")


@stored
def evaluation_by_slot(spark, sf_dir):
    """How scores agree with what was seen, by slot of time."""
    rows = points_then(spark, sf_dir).where("score IS NOT NULL")
    truth = F.col("truth")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 9)
    return rows.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), share(F.col("level") == truth).alias("exact_share"), share(F.abs(F.col("level") - truth) <= 1).alias("adjacent_share"), F.round(F.avg(F.abs(F.col("score") - truth)), 6).alias("mae"))


@stored
def evaluation_report(spark, sf_dir):
    """The whole evaluation, and how well two observers agree."""
    points = points_then(spark, sf_dir).withColumn("score", F.round("score", 9))
    done = evaluation.summarize(points)
    t = load(spark, sf_dir, "truths")
    both = t.select("cafe_id", "slot", "observed_at", F.lit("primary").alias("role"), F.col("observed_area_level").alias("level")).union(t.select("cafe_id", "slot", "observed_at", F.lit("reliability"), "reliability_level"))
    pairs = evaluation.reliability(both, F.col("role"), F.col("observed_at"))
    made = done.crossJoin(pairs)  # a row each
    return made.withColumns({"adjacent_accuracy": F.round("adjacent_accuracy", 9), "spearman": F.round("spearman", 7), "kappa": F.round("kappa", 9)})


@stored
def rescored_scores(spark, sf_dir):
    """Scores kept by micro-batches of snapshots, one of which comes twice and one late."""
    s = load(spark, sf_dir, "snapshots")
    scorer = Rescorer(scratch_path(spark, "rescored"), 8)
    scorer.build(load(spark, sf_dir, "cafes"), load(spark, sf_dir, "hotspots"), s)
    write = scorer.write(now())
    parts = [s.where(f"event_id % 3 = {i}") for i in range(3)]
    for number, batch in enumerate([parts[1], parts[0], parts[2]]):
        write(batch, number)
    write(parts[2], 2)  # once more, as after a failure
    made = scorer.scores(spark)
    text = F.array_join(F.transform("contributors", lambda x: x.hotspot_id.cast("string")), ",")
    return made.select("cafe_id", F.round("score", 6).alias("score"), "coverage", "neighbours", "primary_hotspot_id", F.round("confidence", 9).alias("confidence"), F.coalesce(text, F.lit("")).alias("contributors"))


HOLIDAYS = [date(1995, 5, 5), date(1995, 3, 1), date(1994, 10, 3), date(1994, 9, 20), date(1993, 5, 5)]


@stored
def holiday_baseline(spark, sf_dir):
    """Baselines for a holiday that makes a long weekend, from cells' days in three years."""
    rows = load(spark, sf_dir, "cell_fragments").groupBy("cell_id", "observed_date", "hour").agg(F.bool_and("masked").alias("masked"), F.sum("known_value").cast("double").alias("value"))
    made = baseline.temporal_baseline(rows, "1995-05-05", 5, holidays=HOLIDAYS)
    return made.select("cell_id", "hour", "bucket", "raw_n", F.round("effective_n", 6).alias("effective_n"), F.round("expected", 3).alias("expected"), F.round("dispersion", 6).alias("dispersion"), F.round("masked_share", 9).alias("masked_share"), "fallback_depth")


@stored
def rule_violations(spark, sf_dir):
    """How many rows of each table break the rules of its schema."""
    tables = {
        "hotspots": load(spark, sf_dir, "hotspots"),
        "hotspot_snapshots": load(spark, sf_dir, "snapshots").select(F.when(F.col("event_id") % 5 == 0, 5).otherwise(F.col("level")).alias("congest_level"), "ppltn_min", (F.col("ppltn_max") - 600).alias("ppltn_max")),
        "cafes": load(spark, sf_dir, "cafes"),
        "ingest_cycles": load(spark, sf_dir, "cycle_states"),
        "cafe_scores": scores(spark, sf_dir),
    }
    out = None
    for name, df in tables.items():
        one = audit.rule_counts(df, schemas.RULES[name], name)
        out = one if out is None else out.union(one)
    return out


@stored
def strata_metrics(spark, sf_dir):
    """Persistence for an hour: in all, by part of the city, by day, and by both."""
    rows = delay_pairs(spark, sf_dir).where("horizon = 60")
    rows = rows.select((F.col("hotspot_id") % 4).cast("int").alias("part"), F.to_date("target").alias("day"), F.col("pop").alias("value"), F.col("a_pop").alias("actual"), "level", F.col("a_level").alias("actual_level"))
    made = audit.strata_metrics(rows, ["part", "day"])
    return made.select("stratum", "part", "day", "n", *[F.round(c, 6).alias(c) for c in ("mae", "wape", "bias", "exact", "adjacent")])


def both_releases(spark, sf_dir):
    old = load(spark, sf_dir, "catalogue_a").where("place_id % 9 <> 4")
    new = load(spark, sf_dir, "catalogue_b").where("place_id < 2000000").select((F.col("place_id") - 1000000).alias("place_id"), *(F.col(c).alias(f"new_{c}") for c in ("norm_name", "phone", "lat", "lng")))
    moved = F.abs(F.col("lat") - F.col("new_lat")) * 111320.0
    return old, new, moved


@stored
def refresh_plan(spark, sf_dir):
    """What a refresh would change, before anything is."""
    old, new, moved = both_releases(spark, sf_dir)
    changes = {"names": audit.differs(F.col("norm_name"), F.col("new_norm_name")), "phones": audit.differs(F.col("phone"), F.col("new_phone")), "places": audit.differs(F.col("lat"), F.col("new_lat"), 1e-12)}
    return audit.refresh_plan(old, new, "place_id", changes, moved)


@stored
def largest_moves(spark, sf_dir):
    """The twenty places that a refresh would move farthest."""
    old, new, moved = both_releases(spark, sf_dir)
    return audit.top_moves(old.join(new, "place_id"), F.round(moved, 3), "place_id").select("place_id", "moved_m")


@stored
def band_shortages(spark, sf_dir):
    """Hotspots and bands with fewer than two candidates for evaluation."""
    d = F.col("primary_distance_m")
    band = F.when(d <= 300, "near").when(d <= 600, "mid").when(d <= 1500, "fringe")
    rows = scores(spark, sf_dir).where(d.isNotNull()).select("cafe_id", F.col("primary_hotspot_id").alias("hotspot_id"), "primary_distance_m", band.alias("band"))
    rows = rows.join(load(spark, sf_dir, "cafes").select("cafe_id", "source_confidence"), "cafe_id")
    chosen = audit.best_by_band(rows, "hotspot_id", "band", [F.desc("source_confidence"), F.col("primary_distance_m"), F.col("cafe_id")], 2)
    return audit.shortages(chosen, load(spark, sf_dir, "hotspots").where("is_polled"), "hotspot_id", "band", ["near", "mid", "fringe"], 2)
