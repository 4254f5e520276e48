"""Trials on small literal tables, at the edges of their gates."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera import params
from tessera.operators import stats, trials

T = datetime(2024, 1, 1, 9)
DAY = date(2024, 1, 2)
POINTS = "cafe_id int, observed_at timestamp_ntz, slot string, truth int, score double, level int, coverage string"


def checks(spark, baseline, challenger):
    df = trials.promotion(spark.createDataFrame(baseline, POINTS), spark.createDataFrame(challenger, POINTS))
    return {r["check"]: r.passed for r in df.collect()}


def model(scores, coverage="fringe"):
    """Points of one slot whose truths are 1 to 4."""
    return [(i, T, "s", 1 + i % 4, s, None if s is None else max(1, min(4, int(s + 0.5))), "covered" if i < 4 else coverage) for i, s in enumerate(scores)]


def test_a_better_challenger_is_promoted(spark):
    got = checks(spark, model([1.0, 2.0, 3.0, 4.0, 2.0, 1.0, 3.0, 4.0]), model([1.0, 2.0, 3.0, 4.0, 1.0, 2.0, 3.0, 4.0]))
    assert all(got.values()) and got["promoted"] and len(got) == 8


def test_lost_repeated_and_changed_points_fail(spark):
    base = model([1.0, 2.0, 3.0, 4.0, 2.0, 1.0, 3.0, 4.0])
    lost = checks(spark, base, model([1.0, 2.0, 3.0, 4.0, 1.0, 2.0, 3.0, None]))
    assert lost["identical_primary_rows"] and not lost["no_coverage_loss"] and not lost["promoted"]
    better = model([1.0, 2.0, 3.0, 4.0, 1.0, 2.0, 3.0, 4.0], coverage="covered")
    got = checks(spark, base, [*better, better[0]])
    # segments are the baseline's, whatever the challenger says
    assert not got["identical_primary_rows"] and got["fringe_improvement_evidence"] and got["no_coverage_loss"]
    changed = [*better[:7], (7, T, "s", 1, 4.0, 4, "fringe")]
    assert not checks(spark, base, changed)["identical_primary_rows"]


def test_undefined_metrics_and_empty_reports_fail(spark):
    flat = checks(spark, model([2.0] * 8), model([2.0] * 8))
    assert flat["identical_primary_rows"] and not flat["overall_spearman"] and not flat["fringe_no_serious_regression"]
    none = checks(spark, [], [])
    assert none["identical_primary_rows"] and not none["overall_adjacent_accuracy"] and not none["promoted"]


def test_points_without_keys_meet(spark):
    rows = [(None, None, None, 1, 1.0, 1, None), (1, T, "", 2, 2.0, 2, "covered")]
    got = checks(spark, rows, rows)
    assert got["identical_primary_rows"] and got["no_coverage_loss"] and got["overall_adjacent_accuracy"] is True


def test_distance_without_mass_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("a", 1.0, 0.0), ("b", 1.0, 3.0), ("b", 1.0, 3.0), ("c", 1.0, 0.0), ("c", 0.0, 1.0)], "g string, p double, q double")
    got = {r.g: r.js_distance for r in stats.js_distance(df, ["g"], "p", "q").collect()}
    assert got == {"a": None, "b": 0.0, "c": 1.0}


def weekly(spark, shift):
    """Two weeks of flows among twelve zones; the second week's come from zones shifted by so many."""
    rows = [(DAY + timedelta(days=7 * w), (i * 5 + w * shift) % 12, i, 7, 8, 1 + i % 7, 10.0 + i * i) for w in (0, 1) for i in range(12)]
    moves = spark.createDataFrame(rows, "observed_date date, origin_id int, destination_id int, departure_hour int, arrival_hour int, purpose int, flow double")
    places = spark.createDataFrame([(i, 37.5 + 0.01 * (i % 4), 127.0 + 0.01 * (i // 4)) for i in range(12)], "zone_id int, lat double, lng double")
    return trials.weekly_stability(moves, places)


def test_equal_weeks_are_stable(spark):
    pairs = weekly(spark, 0)
    row = pairs.collect()
    assert len(row) == 1 and row[0].first_date == DAY and row[0].zones == 12 and row[0].unmatched == 0
    assert row[0].net_rho == 1.0 and row[0].top_jaccard == 1.0 and row[0].js_distance == 0.0 and row[0].angle_median == 0.0
    # outbound flow leaves at another hour, so its correlation isn't defined and nothing is supported
    verdict = trials.stability_verdict(pairs).first()
    assert row[0].outbound_rho is None and verdict.scalar == "not_supported" and verdict.purpose == "stable"
    whole = trials.stability_verdict(pairs.withColumn("outbound_rho", F.lit(0.9))).first()
    assert (whole.scalar, whole.vector) == ("supported", "usable")


def test_other_origins_turn_the_bearings(spark):
    row = weekly(spark, 1).first()
    assert row.net_rho == 1.0 and row.angle_median > 0 and row.eligible_share > 0


def day_tables(spark, gone=()):
    """Stocks that grow with the net flow of each zone, in two cells a zone; cells of gone are absent at 9 h."""
    hours = [h + d for h in (8, 14, 18) for d in (-1, 0, 1)]
    stock = [(DAY, z, z * 2 + c, h, z == 0 and c == 1, None if z == 0 and c == 1 else 100.0 + (h % 24) * z) for z in range(6) for c in (0, 1) for h in hours if not (h == 9 and (z, c) in gone)]
    moves = [(DAY, 99, z, h, h, 1, 10.0 + z) for z in range(6) for h in (8, 14, 18)] + [(DAY, z, 99, h, h, 1, 10.0) for z in range(6) for h in (8, 14, 18)]
    flows = spark.createDataFrame(moves, "observed_date date, origin_id int, destination_id int, departure_hour int, arrival_hour int, purpose int, flow double")
    return spark.createDataFrame(stock, "observed_date date, zone_id int, cell_id int, hour int, masked boolean, population double"), flows


def test_same_day_relation_and_its_gates(spark):
    stock, flows = day_tables(spark)
    rows = trials.same_day(stock, flows, params.SameDay(code_coverage=0.8)).collect()
    assert len(rows) == 15 and {r.zones for r in rows} == {6} and {r.rho for r in rows} == {1.0}
    # zone 99 has flows and no stock
    assert {r.code_coverage for r in rows} == {round(6 / 7, 9)} and all(r.gates for r in rows)
    strict = trials.same_day(stock, flows)
    assert [r.verdict for r in trials.same_day_verdict(strict).collect()] == ["rejected"]
    loose = params.SameDay(code_coverage=0.8)
    day = trials.same_day_verdict(trials.same_day(stock, flows, loose), loose).first()
    assert (day.base_verdict, day.verdict, day.sensitive, day.rho_range) == ("screening", "screening", False, 0.0)


def test_absent_cells_are_counted_and_repeats_rejected(spark):
    stock, flows = day_tables(spark, gone={(5, 0)})
    loose = params.SameDay(code_coverage=0.8, cell_jaccard=0.9)
    got = {(r.hour, r.variant): r for r in trials.same_day(stock, flows, loose).collect()}
    assert got[8, "mask2_absent0"].absent_next == 1 and got[8, "mask2_absent0"].absent_now == 0 and got[8, "mask2_absent0"].cells == 12
    assert got[8, "mask2_absent0"].cell_jaccard == pytest.approx(11 / 12) and got[8, "mask2_absent0"].rho < 1 and got[14, "mask2_absent0"].rho == 1.0
    again = trials.same_day(stock.union(stock.limit(1)), flows, loose)
    assert not again.agg(F.bool_and("gates")).first()[0]


def test_held_out_days_alone_count(spark):
    stock, flows = day_tables(spark)
    loose, few = params.SameDay(code_coverage=0.8), params.Repeats(days=1)
    rows = trials.same_day(stock, flows, loose)
    roles = lambda role: spark.createDataFrame([(DAY, role)], "observed_date date, role string")
    held = trials.held_out(rows, roles("held_out"), few, loose).first()
    assert (held.base_verdict, held.verdict, held.defined, held.positive) == ("supported", "supported", 3, 3)
    assert trials.held_out(rows, roles("discovery"), few, loose).first().verdict == "not_supported"
    assert trials.held_out(rows, roles("held_out"), params.Repeats(), loose).first().verdict == "not_supported"
