"""Search, boxes, serving tables and nowcasts at their boundaries."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import materialize, nowcast, search
from tessera.params import NowcastGates

T = datetime(2024, 1, 31, 12)
FORECAST = "array<struct<at:timestamp,pop:double,level:int>>"


def minutes(n):
    return T + timedelta(minutes=n)


def nowcasts(spark, cases):
    rows = [(i, T, minutes(target), 100.0, 1, [(minutes(m), p, lv) for m, p, lv in forecast] if forecast is not None else None) for i, (target, forecast) in enumerate(cases)]
    df = spark.createDataFrame(rows, f"i int, seen timestamp, target timestamp, pop double, level int, f {FORECAST}")
    out = nowcast.estimate(df, "seen", "target", "pop", "level", "f").orderBy("i").collect()
    return [(r.method, r.est_pop, r.est_level) for r in out]


def test_estimates_follow_the_forecast_alone(spark):
    hour = [(60, 160.0, 3)]
    none = ("none", None, None)
    cases = {
        (10, ()): none,  # an observation alone is no forecast
        (10, None): none,
        (0, ((15, 160.0, 3),)): ("nearest", 160.0, 3),  # at the observation's own time there is nothing before
        (0, ((60, 160.0, 3),)): none,
        (30, tuple(hour)): ("interpolated", 130.0, 2),
        (60, tuple(hour)): ("exact", 160.0, 3),
        (80, tuple(hour)): ("nearest", 160.0, 3),
        (81, tuple(hour)): none,
        (-1, tuple(hour)): none,
        (721, ((720, 1.0, 1),)): none,
        (720, ((720, 1.0, 1),)): ("exact", 1.0, 1),
        (700, ((721, 1.0, 1),)): none,  # beyond the horizon
        (45, ((91, 160.0, 3),)): none,  # the gap is over 90 minutes and nothing is near
        (45, ((-30, 50.0, 1), (90, 190.0, 2))): ("interpolated", 145.0, 2),  # what lies before the observation is no anchor
        (30, ((60, 160.0, 3), (60, 161.0, 3))): ("invalid_forecast", None, None),
        (30, ((60, 160.0, 3), (60, 160.0, 3))): ("interpolated", 130.0, 2),
        (70, ((60, 1.0, 1), (80, 2.0, 2))): ("interpolated", 1.5, 2),
        (200, ((190, 1.0, 1), (300, 2.0, 2))): ("nearest", 1.0, 1),
    }
    assert dict(zip(cases, nowcasts(spark, [(t, f and list(f)) for t, f in cases]))) == cases


def test_backtest_counts_reasons_and_gates(spark):
    f = [(minutes(60), 160.0, 2)]
    twice = [*f, (minutes(60), 1.0, 2)]
    rows = [(0, 1, f), (1, 1, []), (2, 1, None), (3, 1, twice), (4, 1, [(minutes(900), 1.0, 1)]), (5, 2, f)]
    origins = spark.createDataFrame([(i, h, T, minutes(30), minutes(60), 100.0, 1, fc) for i, h, fc in rows], f"_id int, hotspot_id int, observed_at timestamp, fetched_at timestamp, target timestamp, pop double, level int, forecast {FORECAST}")
    estimated = nowcast.estimate(origins, "observed_at", "target", "pop", "level", "forecast")
    # the nearest was fetched too early; of the two others the earlier is taken
    actual = spark.createDataFrame([(1, minutes(60), minutes(30), 1.0, 4), (1, minutes(55), minutes(90), 200.0, 2), (1, minutes(65), minutes(95), 300.0, 3)], "hotspot_id int, seen_at timestamp, seen_fetched_at timestamp, actual_pop double, actual_level int")
    r = nowcast.backtest(estimated, actual, gates=NowcastGates(1, 1, 0.0, 0.2, 0.7, 0.95)).first()
    assert (r.origins, r.samples, r.hotspots, r.skipped_no_forecast, r.skipped_invalid_forecast, r.skipped_no_target_estimate, r.skipped_actual_outside_tolerance) == (6, 1, 1, 2, 1, 1, 1)
    assert (r.wape, r.persistence_wape, r.exact, r.adjacent, r.span_days, r.mean_lag_min) == (0.2, 0.5, 1.0, 1.0, 0.0, 30.0)
    assert r.blockers == [] and r.eligible
    none = nowcast.backtest(estimated.limit(0), actual).first()
    assert none.samples == 0 and not none.eligible and len(none.blockers) == 9 and none.blockers[0] == "insufficient_samples"


def cafes(spark):
    rows = [(1, "Blue Bean", "1 Long Road", 37.5, 127.0, True), (2, "bean", None, 37.6, 127.0, True), (3, "Beanery 100%", "x", 37.55, 127.0, True), (4, "Tea", "2 Bean Street", 37.5, 127.1, True), (5, "bean", "x", 37.5, 127.0, False), (6, "bean", "x", 38.5, 127.0, True)]
    return spark.createDataFrame(rows, "cafe_id int, name string, road string, lat double, lng double, active boolean")


def ids(df):
    return [r.cafe_id for r in df.collect()]


def test_search(spark):
    c = cafes(spark)
    assert ids(search.search(c, "  BEAN ")) == [2, 3, 1]
    assert ids(search.search(c, "bean", address="road")) == [2, 3, 1, 4]
    assert ids(search.search(c, "bean", origin=(37.5, 127.0))) == [1, 3, 2]
    assert ids(search.search(c, "bean", limit=1)) == [2]
    assert ids(search.search(c, "0%")) == [3] and ids(search.search(c, "_e")) == []
    brands = {"Blue": ["blue bean", "BB"], "Leaf": ["tea"]}
    assert ids(search.search(c, brand="bb", aliases=brands)) == [1] and ids(search.search(c, brand="leaf", aliases=brands)) == [4]
    assert search.brand_terms("Blue", brands) == ["blue", "blue bean", "bb"]
    for bad in ({}, {"q": "a"}, {"q": "x" * 81}, {"q": "bean", "limit": 51}, {"q": "bean", "limit": 0}, {"brand": "none"}, {"q": "bean", "origin": (91, 0)}):
        with pytest.raises(ValueError):
            search.search(c, **bad)
    assert c.select(search.brand_name_matches(F.col("name"), ["blueb ean"]).alias("m")).where("m").count() == 1


def test_boxes(spark):
    assert search.parse_bbox("126.9,37.5,127.1,37.6") == (126.9, 37.5, 127.1, 37.6)
    for bad in ("1,2,3", "a,b,c,d", "127,37,126,38", "126,37,127,37.2", "nan,1,2,3", "126.9,37.5,126.9,37.6", "1e400,1,2,3"):
        with pytest.raises(ValueError):
            search.parse_bbox(bad)
    c = cafes(spark)
    assert search.all_in_box(c.where("cafe_id < 6"), (126.0, 37.0, 128.0, 38.0)).count() == 5
    with pytest.raises(Exception, match="outside the box"):
        search.all_in_box(c, (126.0, 37.0, 128.0, 38.0)).collect()
    assert [r.cafe_id for r in search.page(c, "cafe_id", 2, 2).collect()] == [3, 4] and [r.cafe_id for r in search.page(c, "cafe_id", None, 1).collect()] == [1]


def test_serving_tables(spark):
    spots = spark.createDataFrame([(1, 37.5, 127.0, True), (2, 37.501, 127.0, True), (3, 37.5, 127.0, False)], "hotspot_id int, lat double, lng double, is_polled boolean")
    seen = [(1, 10, minutes(-800), 1), (1, 11, minutes(-30), 2), (1, 12, minutes(-5), 4), (2, 13, minutes(-20), 1), (3, 14, minutes(-1), 4)]
    f = [(minutes(m), float(m), 1) for m in (65, 45, 125)]
    snapshots = spark.createDataFrame([(*s, f) for s in seen], f"hotspot_id int, event_id int, observed_at timestamp, level int, forecast {FORECAST}")
    now = F.lit(T)
    states = {r.hotspot_id: r for r in materialize.serving_states(spots, snapshots, now).collect()}
    assert set(states) == {1, 2} and [x.level for x in states[1].trend] == [2, 4] and states[1].observed_at == minutes(-5)
    assert states[1].forecast_1h.pop == 65.0  # 65 and 45 are both ten minutes off 55
    scores = materialize.materialize_scores(cafes(spark), spots, snapshots, now)
    rows = {r.cafe_id: r for r in scores.collect()}
    assert set(rows) == {1, 2, 3, 4, 6} and rows[6].contributors is None and rows[6].coverage == "uncovered"
    assert [(x.hotspot_id, x.level) for x in rows[1].contributors] == [(1, 4), (2, 1)] and sum(x.weight for x in rows[1].contributors) == pytest.approx(1)
    assert rows[1].source_observed_at == minutes(-5)
    r = materialize.coverage_report(scores).first()
    assert (r.cafes, r.covered, r.fringe, r.uncovered) == (5, 1, 0, 4)


def test_cycles_without_an_end(spark):
    from tessera.operators.temporal import running_cycle

    cycles = spark.createDataFrame([(1, minutes(0), minutes(90)), (2, minutes(30), None), (3, minutes(40), minutes(50)), (4, minutes(-9000), None)], "cycle_id int, started_at timestamp, completed_at timestamp")
    snaps = spark.createDataFrame([(i, minutes(m)) for i, m in enumerate((-1, 0, 45, 60, 119, 121, -8000, -1000))], "event_id int, fetched_at timestamp")
    got = {r.event_id: r.cycle_id for r in running_cycle(snaps, cycles, F.lit(minutes(120))).collect()}
    assert got == {0: None, 1: 1, 2: 3, 3: 2, 4: 2, 5: None, 6: 4, 7: None}


def test_confidence_parts(spark):
    from tessera.operators.scoring import confidence_v2, cycle_health

    rows = [(1, 300.0, 1.0, 2, minutes(-15), False), (2, 1500.0, 3.0, 1, minutes(0), True), (2, 900.0, 1.0, 4, minutes(-10), False)]
    df = spark.createDataFrame(rows, "cafe_id int, distance_m double, weight double, level int, observed_at timestamp, inside boolean")
    got = {r.cafe_id: r for r in confidence_v2(df, F.lit(T), F.lit(0.8), samples=F.lit(50)).collect()}
    import math

    assert got[1].spatial == pytest.approx(0.8) and got[1].agreement == 0.5 and got[1].sufficiency < 1
    assert got[1].confidence == pytest.approx(0.3 * 0.8 + 0.3 * math.exp(-1) + 0.25 * 0.5 + 0.15 * 0.8)
    assert got[2].spatial == 1.0 and got[2].agreement == pytest.approx((1 - math.sqrt(0.75 * 0.75**2 + 0.25 * 2.25**2) / 1.5) * math.exp(-1))
    with pytest.raises(Exception, match="future"):
        confidence_v2(df.withColumn("observed_at", F.lit(minutes(3))), F.lit(T), F.lit(0.8)).collect()
    c = spark.createDataFrame([(5, 10, "complete"), (5, 10, "partial"), (5, 10, "failed"), (0, 0, "complete"), (20, 10, "complete")], "s int, t int, k string")
    assert [r.h for r in c.select(cycle_health(F.col("s"), F.col("t"), F.col("k")).alias("h")).collect()] == [0.5, 0.25, 0.0, 0.0, 1.0]


def test_signals_that_a_chain_shares_make_no_pairs(spark):
    from tessera.operators.entity import two_signals

    a = spark.createDataFrame([(i, "chain", str(i), None) for i in range(50)] + [(99, "x", None, "r")], "place_id int, name string, phone string, road string")
    b = spark.createDataFrame([(100 + i, "chain", str(i), None) for i in range(50)] + [(199, "x", None, "r"), (198, "x", "p", "r")], "place_id int, name string, phone string, road string")
    got = {(r.a_id, r.b_id): (r.n_signals, r.status) for r in two_signals(a, b, ["name", "phone", "road"]).collect()}
    assert got == {**{(i, 100 + i): (2, "verified") for i in range(50)}, (99, 199): (2, "ambiguous"), (99, 198): (2, "ambiguous")}


def test_streaming_by_parts(spark, tmp_path):
    from tessera.streaming.snapshots import cycle_row, insert_new, on_target

    target = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "2024-01-01", "a", "a"), (2, "2024-01-02", "a", "b"), (1, "2024-01-01", "a", "a")], "k int, day string, wanted string, found string")
    seen = []
    write = insert_new(target, ["k", "day"], lambda t: seen.append(t.count()), part="day")
    write(rows, 0)
    write(rows, 0)
    write(spark.createDataFrame([(1, "2024-01-02", "a", "a")], rows.schema), 1)
    assert seen == [2, 3] and sorted(p.name for p in (tmp_path / "t").glob("day=*")) == ["day=2024-01-01", "day=2024-01-02"]
    assert on_target(rows, "wanted", "found").count() == 2
    ok = rows.withColumn("ok", F.col("wanted") == F.col("found"))
    assert [tuple(cycle_row(ok.limit(n), 7, m, "ok").first()) for n, m in ((3, 2), (3, 4), (0, 1))] == [(7, 2, 2, 0, "complete"), (7, 4, 2, 2, "partial"), (7, 1, 0, 1, "failed")]
