"""Service reports, activity, evaluation, rescoring, tiles and calls within a budget."""

import math
import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import tiles
from tessera.operators import activity, evaluation, materialize, slo, temporal
from tessera.sources import paged
from tessera.streaming import snapshots as stream
from tessera.streaming.rescore import Rescorer

T = datetime(2024, 1, 31, 12)


def now():
    return F.lit(T)


def at(minutes):
    return T + timedelta(minutes=minutes)


CYCLE = "cycle_id int, started_at timestamp, completed_at timestamp, targets int, saved int, failed int, status string"
SNAPSHOT = "event_id int, hotspot_id int, observed_at timestamp, fetched_at timestamp"


def test_service_report(spark):
    cycles = [(1, at(-50), at(-49), 10, 10, 0, "complete"), (2, at(-45), at(-40), 10, 5, 5, "partial"), (3, at(-20), at(-21), 10, 0, 10, "failed"), (4, at(-12), None, 10, 0, 0, "running"), (5, at(-11), None, 10, 1, 9, "partial"), (6, at(-61), at(-60), 10, 10, 0, "complete")]
    seen = [(1, 1, at(-50), at(-49.5)), (2, 1, at(-45), at(-44)), (3, 2, at(-43), at(-44)), (4, 3, at(-30), at(-30)), (5, 9, at(-30), at(-44))]
    hot = [(1, True), (2, True), (3, True), (4, True), (9, False)]
    args = spark.createDataFrame(cycles, CYCLE), spark.createDataFrame(seen, SNAPSHOT), spark.createDataFrame(hot, "hotspot_id int, is_polled boolean"), now()
    r = slo.report(*args, hours=1.0, cadence_min=5.0).first().asDict()
    want = {"cycles": 5, "terminal": 4, "running": 1, "complete": 1, "partial": 2, "failed": 1, "complete_rate": 0.25, "target_success_rate": 16 / 40, "seconds_n": 2, "seconds_p50": 180.0, "seconds_max": 300.0, "invalid_durations": 2, "interval_min_n": 4, "interval_min_max": 25.0, "expected_cycles": 12}
    want |= {"gaps": 3, "missed_cycles": 1 + 4 + 1, "lag_min_n": 3, "negative_lags": 1, "new_data": 2, "duplicate_or_unchanged": 0, "pending": 1, "no_new_data_failure": 2, "anomalous": 3, "polled": 4, "seen": 3, "coverage_rate": 0.75, "snapshots_n": 3, "snapshots_max": 2}
    assert {k: r[k] for k in want} == want
    gaps = {(g.kind, g.gap_min, g.missed) for g in slo.gaps(args[0], now(), 1.0, 5.0).collect()}
    assert gaps == {("window_head", 10.0, 1), ("between_cycles", 25.0, 4), ("window_tail", 11.0, 1)}
    none = slo.gaps(args[0].limit(0), now(), 1.0, 5.0).collect()
    assert [(g.kind, g.gap_min, g.missed) for g in none] == [("empty_window", 60.0, 11)]
    assert slo.report(args[0].limit(0), args[1].limit(0), args[2].limit(0), now()).first().complete_rate is None
    with pytest.raises(ValueError):
        slo.report(*args, hours=0.0)


REFERENCE = "struct<model_version:string,source_version:string,calendar_version:string,selected_bucket:string,source_hashes:array<string>,window_start:date,window_end:date,cutoff:date,raw_n:int,effective_n:double,fallback_depth:int,masked_share:double>"
FIELDS = "estimate_id int, observation_type string, mode string, contributor_id string, source_id string, source_version string, geometry string, provenance string, value double, value_min double, value_max double, baseline_mean double, baseline_dispersion double, weight double, freshness_score double, quality double, observed_at timestamp, fetched_at timestamp, reference " + REFERENCE
NAMES = [f.split(" ")[0] for f in FIELDS.split(", ")]


def contributor(key, **changes):
    ref = {"model_version": "m", "source_version": "s", "calendar_version": "c", "selected_bucket": "b", "source_hashes": ["h"], "window_start": date(2023, 11, 1), "window_end": date(2024, 1, 1), "cutoff": date(2024, 1, 1), "raw_n": 5, "effective_n": 3.0, "fallback_depth": 0, "masked_share": 0.1}
    row = {"estimate_id": key, "observation_type": "presence_count", "mode": "observed", "contributor_id": "a", "source_id": "s", "source_version": "1", "geometry": "g", "provenance": "p", "value": 20.0, "value_min": None, "value_max": None, "baseline_mean": 10.0, "baseline_dispersion": 0.5, "weight": 1.0, "freshness_score": 0.5, "quality": 1.0, "observed_at": at(-5), "fetched_at": at(-4)}
    for k, v in changes.items():
        (ref if k in ref and k != "source_version" else row)[k] = v
    return tuple(row[n] for n in NAMES[:-1]) + (tuple(ref.values()),)


def estimated(spark, rows, **args):
    return {r.estimate_id: r for r in activity.estimates(spark.createDataFrame(rows, FIELDS), now(), **args).collect()}


def test_activity_of_one_and_several(spark):
    rows = [contributor(1), contributor(2, value=None, value_min=5.0, value_max=20.0, baseline_dispersion=None), contributor(3, value=1e9, baseline_dispersion=0.1)]
    rows += [contributor(4, weight=3.0), contributor(4, contributor_id="b", value=5.0)]
    rows += [contributor(5, mode="baseline_only", value=None, observed_at=None), contributor(6, observed_at=at(-60)), contributor(7, mode="forecast", observed_at=at(30)), contributor(8, mode="forecast", observed_at=at(30), fetched_at=at(-60))]
    got = estimated(spark, rows)
    up, down = math.log1p(20) - math.log1p(10), math.log1p(5) - math.log1p(10)
    assert all(r.error is None for r in got.values())
    assert (got[1].freshness, got[1].current_value, got[1].baseline_mean) == ("fresh", 20.0, 10.0) and got[1].anomaly == pytest.approx(up) and got[1].standardized == pytest.approx(up / 0.5) and got[1].disagreement == 0
    assert (got[2].anomaly, got[2].current_min, got[2].current_max, got[2].standardized_min) == (None, 5.0, 20.0, None) and got[2].anomaly_max == pytest.approx(up)
    assert got[3].standardized == 5.0
    mean = (3 * up + down) / 4
    assert got[4].anomaly == pytest.approx(mean) and got[4].baseline_mean is None and got[4].current_value is None
    assert got[4].disagreement == pytest.approx(math.sqrt((3 * (up - mean) ** 2 + (down - mean) ** 2) / 4))
    assert [(e.contributor_id, e.normalized_weight) for e in got[4].evidence] == [("a", 0.75), ("b", 0.25)]
    assert (got[5].freshness, got[5].anomaly, got[5].baseline_mean, got[5].freshness_score) == ("n/a", None, 10.0, 0.5)
    assert (got[6].freshness, got[6].anomaly_min, got[6].evidence[0].anomaly_min) == ("stale", None, None)
    assert got[7].freshness == "fresh" and got[8].freshness == "stale"


def test_every_fault_of_contributors_is_named(spark):
    faults = {
        "contributor_id": {"contributor_id": " "},
        "baseline_mean": {"baseline_mean": -1.0},
        "reference_text": {"model_version": ""},
        "reference_hashes": {"source_hashes": []},
        "reference_window": {"window_start": date(2024, 1, 1)},
        "reference_cutoff": {"cutoff": date(2023, 12, 31)},
        "reference_raw_n": {"raw_n": 0},
        "reference_effective_n": {"effective_n": 6.0},
        "reference_depth": {"fallback_depth": -1},
        "reference_masked_share": {"masked_share": 1.1},
        "dispersion": {"baseline_dispersion": -0.1},
        "weight": {"weight": 0.0},
        "freshness_score": {"freshness_score": 1.5},
        "quality": {"quality": None},
        "provenance": {"geometry": ""},
        "fetched_at": {"fetched_at": None},
        "fetched_in_the_future": {"fetched_at": at(3)},
        "value_and_interval": {"value_min": 1.0},
        "half_an_interval": {"value": None, "value_min": 1.0},
        "value": {"value": -1.0},
        "interval_order": {"value": None, "value_min": 2.0, "value_max": 1.0},
        "baseline_only_with_observation": {"mode": "baseline_only"},
        "no_observation": {"observed_at": None},
        "observed_in_the_future": {"observed_at": at(3), "fetched_at": at(2)},
        "observed_after_fetch": {"observed_at": at(-3)},
        "forecast_expired": {"mode": "forecast"},
        "forecast_before_fetch": {"mode": "forecast", "observed_at": at(-1.5), "fetched_at": at(1)},
        "cutoff_after_observation": {"window_end": date(2024, 2, 1), "cutoff": date(2024, 2, 1)},
    }
    assert set(faults) == set(activity.contributor_faults(now(), activity.Activity()))
    got = estimated(spark, [contributor(i, **c) for i, c in enumerate(faults.values())])
    assert [got[i].error for i in range(len(faults))] == list(faults)
    assert all(r.anomaly is None and r.evidence is None and r.freshness is None for r in got.values())
    pairs = {"type_or_mode": {"mode": "odd"}, "different_modes": {"mode": "forecast", "observed_at": at(5)}, "duplicate_contributor_id": {"contributor_id": "a"}, "different_sources": {"source_id": "t"}, "different_versions": {"source_version": "2"}, "different_types": {"observation_type": "proxy"}, "fresh_and_stale": {"observed_at": at(-40)}}
    rows = []
    for i, c in enumerate(pairs.values()):
        rows += [contributor(i), contributor(i, **({"contributor_id": "b"} | c))]
    got = estimated(spark, [*rows, contributor(99, mode="unsupported")])
    assert [got[i].error for i in range(len(pairs))] == list(pairs) and got[99].error == "unsupported_with_contributors"


def test_as_of_over_slices(spark):
    """A key with a long history is looked up over slices of any width; rows carry over empty ones."""
    history = [(1, i, at(i * 7), at(i * 7 + (90 if i % 5 == 0 else 1))) for i in range(400)] + [(2, 1000, at(5), at(5)), (1, 1001, at(14), None), (1, 1002, at(14), at(15))]
    asked = [(1, at(m)) for m in range(-10, 3000, 37)] + [(2, at(4)), (2, at(5)), (2, at(90000)), (3, at(1)), (1, at(10)), (1, at(10))]
    h = spark.createDataFrame(history, "k int, id int, seen timestamp, got timestamp")
    a = spark.createDataFrame(asked, "k int, t timestamp")
    want = {(k, t): max([(s, i) for kk, i, s, g in history if kk == k and g is not None and s <= t and g <= t], default=(None, None))[1] for k, t in asked}
    for hours in (0.1, 1.0, 24.0, 10000.0):
        got = temporal.as_of(a, h, "k", "t", "seen", "got", "id", hours).collect()
        assert {(r.k, r.t): r.id for r in got} == want and len(got) == len(want)


PLACES = "hotspot_id bigint, lat double, lng double, is_polled boolean"
SEEN = "hotspot_id bigint, event_id bigint, observed_at timestamp, fetched_at timestamp, level int"


def city(spark, n=200):
    hot = spark.createDataFrame([(h, 37.5 + h * 0.003, 127.0 + (h % 3) * 0.004, h % 10 != 9) for h in range(30)], PLACES)
    cafes = spark.createDataFrame([(c, 37.49 + (c * 37 % 100) * 0.0011, 127.0 + (c % 7) * 0.002, c % 11 != 0) for c in range(n)], "cafe_id bigint, lat double, lng double, active boolean")
    return cafes, hot


def test_scores_are_those_of_their_time(spark):
    cafes, hot = city(spark, 40)
    rows = [(h, 100 * h + i, at(i * 30 + h), at(i * 30 + h + (200 if (h + i) % 4 == 0 else 2)), 1 + (h * 3 + i) % 4) for h in range(30) for i in range(6)]
    seen = spark.createDataFrame(rows, SEEN)
    asked = [(c, at(m)) for c in (1, 2, 5, 11, 39, 999) for m in (-5, 31, 100, 400)]
    got = {(r.cafe_id, r.observed_at): (r.score, r.level, r.coverage, r.neighbours, r.confidence) for r in evaluation.scores_as_of(spark.createDataFrame(asked, "cafe_id bigint, observed_at timestamp"), cafes, hot, seen, slice_hours=1.0).collect()}
    assert set(got) == {(c, t) for c, t in asked if c != 999}
    for moment in {t for _, t in asked}:
        known = seen.where((F.col("observed_at") <= F.lit(moment)) & (F.col("fetched_at") <= F.lit(moment)))
        made = {r.cafe_id: (r.score, r.level if r.score is not None else None, r.coverage, r.neighbours, r.confidence) for r in materialize.materialize_scores(cafes.withColumn("active", F.lit(True)), hot, known, F.lit(moment)).collect()}
        for c in (1, 2, 5, 11, 39):
            a, b = got[c, moment], made[c]
            assert a[2:4] == b[2:4] and a[0] == (None if b[0] is None else pytest.approx(b[0], abs=1e-12)) and a[4] == (None if b[4] is None else pytest.approx(b[4], abs=1e-12))


def test_reliability_and_summary(spark):
    rows = [(1, "a", "primary", 1, 1), (1, "a", "reliability", 2, 2), (1, "a", "primary", 3, 4), (2, "a", "primary", 1, 4), (2, "a", "reliability", 2, 3), (3, "a", "primary", 1, 2), (4, None, "primary", 1, 2), (4, None, "reliability", 1, 2)]
    df = spark.createDataFrame(rows, "cafe_id int, slot string, role string, n int, level int")
    r = evaluation.reliability(df, F.col("role"), F.col("n")).first()
    assert r.pairs == 3 and r.kappa == pytest.approx(1 - (2 / 27) / (sum((a - b) ** 2 for a in (1, 4, 2) for b in (2, 3, 2)) / 81))
    none = evaluation.reliability(df.limit(0), F.col("role"), F.col("n")).first()
    assert (none.pairs, none.kappa) == (0, None)
    points = spark.createDataFrame([("a", 1, 1.0, 1, "covered"), ("a", 2, 2.0, 2, "covered"), ("", 4, 1.0, 1, "fringe"), ("b", 3, None, None, "uncovered"), ("b", 3, 3.0, 3, "covered")], "slot string, truth int, score double, level int, coverage string")
    s = evaluation.summarize(points).first()
    assert (s.rows, s.uncovered, s.observations, s.adjacent_accuracy, s.spearman, s.slots) == (5, 1, 4, 0.75, 1.0, 1)


def test_stream_rescores_what_changes(spark, tmp_path):
    """A stream's scores are those of materialize_scores; a batch reads and writes what its hotspots touch."""
    cafes, hot = city(spark)
    rows = [(h, 1000 * b + h, at(b * 10 + h % 7), at(b * 10 + 9), 1 + (h + b) % 4) for b in range(4) for h in range(30) if b == 0 or h // 3 == 2 * b]
    rows += [(3, 1, at(-100), at(50), 4), (None, 5, at(1), at(1), 1), (77, 6, at(1), at(1), 1), (4, 7, None, at(1), 2)]
    seen = spark.createDataFrame(rows, SEEN).withColumn("b", F.when(F.col("event_id") >= 1000, F.floor(F.col("event_id") / 1000)).when(F.col("event_id") == 1, 3).otherwise(0))
    source = f"{tmp_path}/in"
    for b in range(4):
        seen.where(F.col("b") == b).drop("b").coalesce(1).write.mode("append").parquet(source)
    scorer = Rescorer(f"{tmp_path}/scores", 16)
    scorer.build(cafes, hot, seen)
    stream.start(spark.readStream.schema(SEEN).option("maxFilesPerTrigger", 1).parquet(source), f"{tmp_path}/check", scorer.write(F.lit(at(60)))).awaitTermination(240)
    want = {r.cafe_id: r for r in materialize.materialize_scores(cafes, hot, seen.where("hotspot_id IS NOT NULL AND observed_at IS NOT NULL"), F.lit(at(60))).collect()}

    def check():
        got = {r.cafe_id: r for r in scorer.scores(spark).collect()}
        assert set(got) == set(want)
        for c, w in want.items():
            assert (got[c].coverage, got[c].level, got[c].neighbours, got[c].primary_hotspot_id, got[c].contributors) == (w.coverage, w.level, w.neighbours, w.primary_hotspot_id, w.contributors)

    check()
    counts = [spark.read.parquet(f"{scorer.root}/scores/{d}").count() for d in sorted(os.listdir(f"{scorer.root}/scores")) if d.startswith("batch")]
    assert len(counts) == 4 and max(counts[1:]) < 0.6 * counts[0]
    before = spark.read.parquet(f"{scorer.root}/scores/batch=3").count()
    scorer.write(F.lit(at(60)))(seen.where("b = 3").drop("b"), 3)
    assert spark.read.parquet(f"{scorer.root}/scores/batch=3").count() == before
    scorer.write(F.lit(at(60)))(seen.where("b = 1").drop("b"), 9)  # nothing later than what is known
    assert not os.path.exists(f"{scorer.root}/scores/batch=9")
    check()
    scorer.fold(spark)
    assert [d for d in os.listdir(f"{scorer.root}/latest") if d.startswith("batch")] == ["batch=3"]
    check()
    some = spark.createDataFrame([(1,)], "hotspot_id bigint")
    plan = scorer.index(spark, "hotspot_id", some)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "part" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_tiles(spark):
    cols = "west double, south double, east double, north double, zoom double"
    views = [(126.9, 37.5, 127.0, 37.6, 15.9), (126.9, 37.5, 127.0, 37.6, 3.0), (179.99, -1.0, -179.99, 1.0, 10.0), (-180.0, -90.0, 180.0, 90.0, 12.0), (127.0, 37.5, 127.0, 37.5, 15.0), (0.0, 0.0, 0.0, 0.0, 12.0)]
    df = spark.createDataFrame(views, cols)
    got = [[tuple(t) for t in r[0]] for r in df.select(tiles.cover(*(F.col(c.split(" ")[0]) for c in cols.split(", ")))).collect()]
    near, far, across, world, point, corner = got
    assert {z for z, *_ in near} == {13} and len(near) <= 16 and {z for z, *_ in far} == {10} and len(set(near)) == len(near)
    assert {x for _, x, _ in across} == {1023, 0} and {y for *_, y in across} <= set(range(508, 516))
    assert len(world) == 1024 * 1024 and len(point) == 1 and corner == []
    one = spark.createDataFrame([near[0]], "z int, x int, y int").select(tiles.bounds(*map(F.col, "zxy")).alias("b"), tiles.children(*map(F.col, "zxy")).alias("c")).first()
    assert one.b.west <= 126.9 < one.b.east and [(c.z, c.x - 2 * near[0][1], c.y - 2 * near[0][2]) for c in one.c] == [(14, 0, 0), (14, 1, 0), (14, 0, 1), (14, 1, 1)]
    inside = spark.createDataFrame([(0.0, 179.995), (0.0, -179.995), (0.0, 0.0), (2.0, 180.0)], "lat double, lng double").select(tiles.in_viewport(F.col("lat"), F.col("lng"), *(F.lit(v) for v in views[2][:4])))
    assert [r[0] for r in inside.collect()] == [True, True, False, False]


def test_wide_viewports_list_no_tiles(spark, sf_dir):
    plan = catalog.QUERIES["viewport_tiles"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan  # a whole turn at the least zoom would be a million tiles in one row
    views = spark.createDataFrame([(-180.0, -90.0, 180.0, 90.0, 12.0), (10.0, 0.0, 369.9999, 1.0, 10.0), (0.0, 0.0, 0.0, 0.0, 12.0)], "west double, south double, east double, north double, zoom double")
    r = tiles.cover_range(*map(F.col, views.columns))
    got = views.select(tiles.range_size(r).alias("n"), F.size(tiles.cover(*map(F.col, views.columns))).alias("listed")).collect()
    assert [x.n for x in got] == [x.listed for x in got] and got[0].n == 1 << 20 and got[2].n == 0


def test_only_places_that_can_count_are_looked_up(spark):
    since = [9, 9, 7, 8, 7, 3, 6, 5, 1, 2, 4, 0]
    places = spark.createDataFrame([(i, 37.5 + i // 20, 127.0, s) for i, s in enumerate(since + [5] * 8 + since)], "hotspot_id int, p_lat double, p_lng double, since int")
    for k in (1, 2, 3):
        kept = [(r.p_lat, r.hotspot_id, r.since) for r in evaluation.first_known(places, "hotspot_id", "since", k).collect()]
        rows = [(r.p_lat, r.hotspot_id, r.since) for r in places.collect()]
        for at in {r[0] for r in rows}:
            for t in range(10):
                known = lambda of: sorted(i for y, i, s in of if y == at and s <= t)[:k]  # noqa: B023, E731
                assert known(kept) == known(rows)
        assert len(kept) < len(rows)


def test_spots_are_rescored_once(spark, tmp_path):
    cafes = spark.createDataFrame([(i, 37.5 + i % 2, 127.0, True) for i in range(40)] + [(99, None, 127.0, True)], "cafe_id bigint, lat double, lng double, active boolean")
    hot = spark.createDataFrame([(i, 37.501, 127.0, True) for i in range(30)], "hotspot_id bigint, lat double, lng double, is_polled boolean")
    seen = spark.createDataFrame([(i, 30 - i, at(i), at(i), 1 + i % 4) for i in range(1, 20)], "event_id bigint, hotspot_id bigint, observed_at timestamp, fetched_at timestamp, level int")
    scorer = Rescorer(f"{tmp_path}/scores", 4)
    scorer.build(cafes, hot, seen)
    assert spark.read.parquet(f"{scorer.root}/by_spot").count() == 1  # 600 pairs of a cafe and a hotspot
    for b in range(3):
        scorer.write(F.lit(at(60)))(seen.where(f"event_id % 3 = {b}"), b)
    got, want = ({r.cafe_id: (r.score, r.coverage, r.contributors) for r in df.collect()} for df in (scorer.scores(spark), materialize.materialize_scores(cafes, hot, seen, F.lit(at(60)))))
    assert got == want and got[0][0] is not None and got[99][1] == "uncovered"


CALLS = "/tmp/tessera-paged-calls"


def note(page):
    with open(os.environ.get("PAGED_CALLS", CALLS), "a") as f:
        f.write(f"{page}\n")


def steady(page, size):
    note(page)
    return 25, [{"i": i} for i in range(page * size, min(25, (page + 1) * size))]


def shaky(page, size):
    """Page 2 asks to wait before it answers."""
    note(page)
    if page == 2 and open(os.environ.get("PAGED_CALLS", CALLS)).read().count("2\n") % 2:
        raise paged.Throttled(0.01)
    return 25, [{"i": i} for i in range(page * size, min(25, (page + 1) * size))]


def broken(page, size):
    note(page)
    if page == 3:
        raise OSError("gone")
    return 25, [{"i": i} for i in range(page * size, min(25, (page + 1) * size))]


@pytest.fixture
def calls():
    open(CALLS, "w").close()
    return lambda: len(open(CALLS).read().split())


def test_calls_stay_within_a_budget(spark, tmp_path, calls):
    spark.dataSource.register(paged.MeteredSource)
    read = lambda fetch, **o: spark.read.format("metered").options(fetch=f"test_evidence:{fetch}", size=5, **o).load()
    assert read("steady", budget=6).count() == 25 and calls() == 6
    with pytest.raises(Exception, match="5 pages need more"):
        read("steady", budget=5).count()
    open(CALLS, "w").close()
    rows = read("shaky", budget=11).collect()
    assert len(rows) == 25 and {r.page: r.calls for r in rows} == {0: 1, 1: 1, 2: 2, 3: 1, 4: 1}
    with pytest.raises(Exception, match="no call is left"):
        read("shaky", budget=6).count()
    assert sorted(r.page for r in read("steady", pages="1-2").collect()) == [1] * 5 + [2] * 5


def test_waits_follow_what_the_interface_says():
    waits = []
    answers = iter([paged.Throttled(7.0), paged.Throttled(99.0), OSError(), paged.Throttled(None)])

    def fetch(page, size):
        if (a := next(answers, None)) is not None:
            raise a
        return 1, [{}]

    globals()["told"] = fetch
    import test_evidence

    test_evidence.told = fetch
    reader = paged.PagedReader({"fetch": "test_evidence:told", "retries": "5"}, sleep=waits.append)
    assert reader.fetch(0) == (1, [{}], 5) and waits == [7.0, 30.0, 0.2, 0.4]


def test_fetching_goes_on_where_it_stopped(spark, tmp_path, calls):
    at = f"{tmp_path}/pages"
    with pytest.raises(Exception, match="gone"):
        paged.fetch_into(spark, at, "test_evidence:broken", 5, per_round=1)
    assert sorted(p.name for p in (tmp_path / "pages").glob("round=*")) == ["round=0", "round=1", "round=2"]
    with pytest.raises(ValueError, match="manifest"):
        paged.fetch_into(spark, at, "test_evidence:steady", 5, per_round=1)
    (tmp_path / "pages/manifest.json").write_text((tmp_path / "pages/manifest.json").read_text().replace("broken", "steady"))
    (tmp_path / "pages/.manifest.json.crc").unlink(missing_ok=True)
    before = calls()
    with pytest.raises(paged.BudgetSpent):
        paged.fetch_into(spark, at, "test_evidence:steady", 5, budget=3, per_round=1)
    rows = paged.fetch_into(spark, at, "test_evidence:steady", 5, budget=4, per_round=1)
    assert rows.count() == 25 and calls() - before <= 3 + 4
