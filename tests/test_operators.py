"""Operators on small literal tables, at the edges that matter."""

import math
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.functions import geo, text, timing
from tessera.operators import baseline, entity, flows, scoring, spatial, stats, temporal

NOW = datetime(2024, 1, 1, 12, 0)
NORTH = math.degrees(1 / 6_371_008.8)  # one metre north


def points(spark, *metres):
    return spark.createDataFrame([(i, 37.5 + m * NORTH, 127.0) for i, m in enumerate(metres)], "cafe_id int, lat double, lng double")


def spots(spark, *rows):
    return spark.createDataFrame([(i, 37.5, 127.0, level, NOW - timedelta(minutes=age)) for i, level, age in rows], "hotspot_id int, p_lat double, p_lng double, level int, observed_at timestamp_ntz")


def test_coverage_bounds_and_single_neighbour(spark):
    got = {r.cafe_id: r for r in scoring.score_points(points(spark, 0, 599.9, 600.1, 1499.9, 1500.1), spots(spark, (7, 3, 0)), F.lit(NOW)).collect()}
    assert [got[i].coverage for i in range(5)] == ["covered", "covered", "fringe", "fringe", "uncovered"]
    assert got[0].confidence == pytest.approx(0.5) and got[0].tier == "medium" and got[0].level == 3
    assert got[4].level is None and got[4].score is None and got[4].confidence is None and got[4].neighbours == 0


def test_equal_distances_go_by_id_and_k_is_three(spark):
    got = scoring.score_points(points(spark, 100), spots(spark, (9, 4, 5), (2, 1, 30), (5, 1, 40), (4, 2, 1)), F.lit(NOW)).first()
    assert got.primary_hotspot_id == 2 and got.neighbours == 3 and got.score == pytest.approx(4 / 3)
    assert got.source_observed_at == NOW - timedelta(minutes=30)
    assert got.confidence == pytest.approx((1 - 100 / 1500) * math.exp(-1 / 15), rel=1e-6)


def test_levels_round_half_up(spark):
    df = spark.createDataFrame([(x,) for x in (0.2, 1.49, 1.5, 2.5, 4.6, None)], "x double")
    assert [r[0] for r in df.select(timing.half_up_level(F.col("x"))).collect()] == [1, 1, 2, 3, 4, None]


def test_radius_join_finds_what_a_nested_loop_finds(spark):
    a = spark.createDataFrame([(i, 37.4 + (i * 37 % 100) * 0.003, 126.8 + (i * 61 % 100) * 0.004) for i in range(300)], "cafe_id int, lat double, lng double")
    b = spark.createDataFrame([(i, 37.4 + (i * 53 % 97) * 0.003, 126.8 + (i * 29 % 97) * 0.004) for i in range(200)], "hotspot_id int, p_lat double, p_lng double")
    got = {(r.cafe_id, r.hotspot_id) for r in spatial.radius_pairs(a, b, 900.0).collect()}
    loop = a.crossJoin(b).where(geo.haversine_m(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng")) <= 900)
    assert got == {(r.cafe_id, r.hotspot_id) for r in loop.collect()} and got
    plan = spatial.radius_pairs(a, b, 900.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_freshness_bounds(spark):
    ages = [-2.1, -2, 0, 25, 25.01, 120, 120.01]
    df = spark.createDataFrame([(i, NOW - timedelta(minutes=a)) for i, a in enumerate(ages)] + [(9, None)], "i int, t timestamp_ntz")
    got = {r.i: r for r in df.select("i", timing.freshness(F.col("t"), F.lit(NOW)).alias("f"), timing.whole_age(F.col("t"), F.lit(NOW)).alias("a")).collect()}
    assert [got[i].f for i in range(7)] == ["stale", "fresh", "fresh", "fresh", "delayed", "delayed", "stale"] and got[9].f == "n/a"
    assert [got[i].a for i in range(5)] == [None, 0, 0, 25, 26]


def test_as_of_needs_both_times(spark):
    h = spark.createDataFrame([(1, 1, NOW, NOW + timedelta(minutes=30), 2), (1, 2, NOW + timedelta(minutes=5), NOW + timedelta(minutes=6), 3)], "k int, e int, o timestamp_ntz, f timestamp_ntz, level int")
    asked = spark.createDataFrame([(1, NOW + timedelta(minutes=m)) for m in (0, 6, 40)] + [(2, NOW)], "k int, t timestamp_ntz")
    got = {(r.k, r.t): r.level for r in temporal.as_of(asked, h, "k", "t", "o", "f", "e").collect()}
    assert got == {(1, NOW): None, (1, NOW + timedelta(minutes=6)): 3, (1, NOW + timedelta(minutes=40)): 3, (2, NOW): None}


def test_nearest_in_time_takes_the_earlier_of_two(spark):
    asked = spark.createDataFrame([(1, "a", NOW), (2, "a", NOW + timedelta(minutes=20))], "_id int, k string, target timestamp_ntz")
    actual = spark.createDataFrame([("a", NOW + timedelta(minutes=2.5)), ("a", NOW - timedelta(minutes=2.5)), ("b", NOW)], "k string, at timestamp_ntz")
    got = temporal.nearest_in_time(asked, actual, "k", "target", "at", 2.5).collect()
    assert [(r._id, r.at) for r in got] == [(1, NOW - timedelta(minutes=2.5))]


def test_spearman_ties_and_constants(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("b", 1, 5), ("b", 1, 6), ("c", 1, 1)], "g string, x int, y int")
    got = {r.g: r.rho for r in stats.spearman(df, ["g"], "x", "y").collect()}
    assert got["a"] == pytest.approx(math.sqrt(0.75)) and got["b"] is None and got["c"] is None


def test_kappa_needs_two_levels(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 4, 4), ("b", 1, 1), ("b", 1, 2)], "g string, x int, y int")
    got = {r.g: r.kappa for r in stats.weighted_kappa(df, ["g"], "x", "y").collect()}
    assert got["a"] == pytest.approx(1.0) and got["b"] is None


def test_opposite_flows_cancel(spark):
    f = spark.createDataFrame([(2, 1, 8, 9, 3.0), (3, 1, 8, 9, 3.0), (1, 1, 8, 9, 5.0), (1, 4, 8, 9, 1.0)], "origin_id int, destination_id int, departure_hour int, arrival_hour int, flow double")
    c = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 0.0, -1.0)], "zone_id int, lat double, lng double")
    got = {r.zone_id: r for r in flows.direction(f, c).collect()}
    assert got[1].strength == pytest.approx(0.0, abs=1e-12) and got[1].bearing is None and got[1].coverage == 1.0
    assert got[4].coverage == 0.0 and got[4].strength is None
    net = {(r.zone_id, r.hour): (r.inbound, r.outbound, r.net, r.intrazonal) for r in flows.net_flow(f).collect()}
    assert net[(1, 9)] == (11.0, 0.0, 11.0, 5.0) and net[(1, 8)] == (0.0, 6.0, -6.0, 0.0)


def test_baseline_excludes_the_cutoff_and_shrinks(spark):
    cutoff = date(2024, 3, 6)  # a Wednesday
    rows = [(1, 8, cutoff - timedelta(days=7 * k), 100.0, False) for k in range(0, 4)] + [(1, 8, cutoff - timedelta(days=85), 9e9, False), (1, 8, cutoff - timedelta(days=1), 10.0, False), (2, 8, cutoff - timedelta(days=3), None, True)]
    df = spark.createDataFrame(rows, "cell_id int, hour int, observed_date date, value double, masked boolean")
    got = {r.cell_id: r for r in baseline.temporal_baseline(df, "2024-03-06", 3).collect()}
    assert (got[1].bucket, got[1].raw_n) == ("exact", 3) and 10 < got[1].expected < 100
    assert (got[2].bucket, got[2].raw_n) == ("hour", 1) and got[2].expected == pytest.approx(2.0)


def test_reconcile_abstains(spark):
    schema = "place_id int, norm_name string, phone string, lat double, lng double"
    a = spark.createDataFrame([(1, "x", "1", 37.5, 127.0), (2, "y", None, 37.6, 127.0), (3, "z", "3", 37.7, 127.0)], schema)
    b = spark.createDataFrame([(11, "x", "1", 37.5, 127.0), (12, "y", None, 37.6, 127.0), (13, "y", None, 37.6 + 10 * NORTH, 127.0), (14, "q", "3", 37.7 + 149 * NORTH, 127.0), (15, "z", None, 37.7 + 51 * NORTH, 127.0)], schema)
    got = {(r.a_id, r.b_id): (r.rule, r.status) for r in entity.reconcile(entity.candidate_pairs(a, b)).collect()}
    assert got == {(1, 11): ("both", "verified"), (2, 12): ("name", "ambiguous"), (2, 13): ("name", "ambiguous"), (3, 14): ("phone", "verified")}


def test_release_diff_kinds(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, None, 1.0), (3, "c", 1.0)], "k int, n string, x double")
    new = spark.createDataFrame([(1, "a", 1.0 + 1e-13), (2, "b", 1.0), (4, "d", 1.0)], "k int, n string, x double")
    got = {r.k: (r.change, r.n_changed) for r in entity.release_diff(old, new, "k", ["n", "x"], 1e-12, ("x",)).collect()}
    assert got == {1: ("unchanged", 0), 2: ("update", 1), 3: ("deactivate", 0), 4: ("insert", 0)}


def test_polygons(spark):
    ring = ([0.0, 0.0, 2.0, 2.0], [0.0, 2.0, 2.0, 0.0])
    df = spark.createDataFrame([(1.0, 1.0, *ring), (0.0, 1.0, *ring), (2.0, 2.0, *ring), (2.1, 1.0, *ring)], "lat double, lng double, ys array<double>, xs array<double>")
    assert [r[0] for r in df.select(geo.inside(F.col("lat"), F.col("lng"), F.col("ys"), F.col("xs"))).collect()] == [True, True, True, False]
    area = df.limit(1).select(geo.shoelace_m2(F.col("ys"), F.col("xs"), F.lit(0.0))).first()[0]
    assert area == pytest.approx((2 * geo.M_PER_DEGREE) ** 2)


def test_texts(spark):
    df = spark.createDataFrame([("+82 2-123-4567", "<b>Caf&eacute;</b> A &amp;  B", "Ａ１ ｶﾌｪ-Σς")], "p string, t string, n string")
    r = df.select(text.national_phone(F.col("p")).alias("p"), text.strict_phone(F.lit("call 123456789")).alias("s"), text.without_tags(F.col("t")).alias("t"), text.folded_name("n").alias("n")).first()
    assert r.p == "021234567" and r.s is None and r.t == "Caf&eacute; A &  B" and r.n == "a1カフェσσ"


def test_minutes_of_codes(spark):
    df = spark.createDataFrame([(x,) for x in ("00", "0830", "23", "24", "0860", "8")], "c string")
    assert [r[0] for r in df.select(timing.hhmm_minute(F.col("c"))).collect()] == [0, 510, 1380, None, None, None]


def test_grid_cells(spark):
    from tessera.functions import grid

    ids = ["다사60007500", "다사60007501", "다자60007500", "x", None]
    df = spark.createDataFrame([(c,) for c in ids], "c string")
    e, n = grid.corner(F.col("c"))
    got = df.select(e.alias("e"), n.alias("n")).collect()
    assert (got[0].e, got[0].n) == (960000.0, 1975000.0) and all(r.e is None for r in got[1:])
    lat, lng = grid.to_lat_lng(F.lit(1_000_000.0), F.lit(2_000_000.0))
    r = df.limit(1).select(lat.alias("lat"), lng.alias("lng"), grid.ring(F.col("c")).alias("ring"), geo.haversine_m(*(F.get(grid.ring(F.col("c")), F.lit(i))[k] for i in (0, 1) for k in ("lat", "lng"))).alias("side")).first()
    assert r.lat == pytest.approx(38.0, abs=1e-9) and r.lng == pytest.approx(127.5, abs=1e-9)
    assert r.side == pytest.approx(250, rel=0.005) and 37.7 < r.ring[0].lat < 37.8 and 127.0 < r.ring[0].lng < 127.1


def test_schemas_parse(spark):
    from tessera import schemas

    for name, ddl in schemas.TABLES.items():
        empty = spark.createDataFrame([], ddl)
        assert empty.where(" AND ".join(f"({r})" for r in schemas.RULES.get(name, {"all": "true"}).values())).count() == 0


def test_baseline_with_holidays(spark):
    target, other = date(2024, 3, 1), date(2024, 2, 9)  # Fridays before a weekend, so in long blocks
    held = [target, other, date(2023, 3, 1), date(2024, 1, 10)]
    assert baseline.holiday_types(held) == {**{date(2024, 3, d): "long_holiday" for d in (1, 2, 3)}, **{date(2024, 2, d): "long_holiday" for d in (9, 10, 11)}, date(2023, 3, 1): "public_holiday", date(2024, 1, 10): "public_holiday"}
    fridays = [(1, 8, target - timedelta(days=7 * k), 100.0 if k != 3 else 10.0, False) for k in range(1, 9)]
    weekend = [(1, 8, date(2024, 2, 10), 10.0, False), (1, 8, date(2024, 2, 11), 10.0, False)]
    rows = fridays + weekend + [(2, 8, date(2022, 3, 4), 50.0, False), (3, 8, target - timedelta(days=1100), 5.0, False)]
    rows += [(4, 8, target - timedelta(days=7 * k), 30.0, False) for k in (1, 2, 4)] + [(4, 8, date(2024, 2, 28), 7.0, False)]
    df = spark.createDataFrame(rows, "cell_id int, hour int, observed_date date, value double, masked boolean")
    got = {r.cell_id: r for r in baseline.temporal_baseline(df, "2024-03-01", 5, holidays=held).collect()}
    assert (got[1].bucket, got[1].raw_n) == ("type", 3) and 10 < got[1].expected < 100
    a = got[1].effective_n / (got[1].effective_n + 4)
    assert math.log1p(got[1].expected) == pytest.approx(a * math.log1p(10) + (1 - a) * math.log1p(100))
    assert (got[2].bucket, got[2].raw_n, got[2].expected) == ("hour", 1, pytest.approx(50)) and 3 not in got
    assert (got[4].bucket, got[4].raw_n) == ("nominal", 3)
    plain = {r.cell_id: r for r in baseline.temporal_baseline(df, "2024-03-08", 5, holidays=held).collect()}
    assert (plain[1].bucket, plain[1].raw_n) == ("exact", 7)  # the holiday isn't a working Friday


def test_null_keys(spark, tmp_path):
    from tessera.operators import audit
    from tessera.streaming.snapshots import insert_new

    rows = spark.createDataFrame([(1, "a"), (None, "a"), (None, None), (2, None)], "k int, day string")
    for part in (None, "day"):
        target = f"{tmp_path}/{part}"
        write = insert_new(target, ["k", "day"], part=part)
        write(rows, 0)
        write(rows.union(rows), 1)
        write(rows.where("k IS NULL").union(spark.createDataFrame([(3, None)], "k int, day string")), 2)
        assert spark.read.parquet(target).count() == 5
    left, right = spark.createDataFrame([(1,), (None,), (1,)], "k int"), spark.createDataFrame([(None,), (2,)], "k int")
    assert sorted(map(str, (tuple(r) for r in audit.key_sides(left, right, "k").collect()))) == ["(1, 'left')", "(2, 'right')", "(None, 'both')"]


def test_rows_of_overlapping_tiles(spark):
    from tessera.operators.search import merge_tiles

    a = spark.createDataFrame([(1, 1.0, 1.0, "old"), (2, 9.0, 1.0, "out")], "id int, lat double, lng double, name string")
    b = spark.createDataFrame([(1, 1.0, 1.0, "new"), (3, 2.0, 2.0, "y"), (3, 2.0, 2.0, "x"), (4, 2.0, None, "z")], "id int, lat double, lng double, name string")
    got = merge_tiles([a, b], "id", (0.0, 0.0, 5.0, 5.0)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1.0, 1.0, "old"), (3, 2.0, 2.0, "x")] and got[0].__fields__ == ["id", "lat", "lng", "name"]


def test_small_variance_around_a_large_mean(spark):
    from tessera.operators import stats

    df = spark.createDataFrame([(1.0, 1e9 + 1), (1.0, 1e9 + 2), (2.0, 1e9 + 3)], "w double, x double")
    mean, var, n = df.agg(*[c.alias(k) for k, c in zip("mvn", stats.weighted_stats(F.col("w"), F.col("x"), 1e9))]).first()
    assert (mean - 1e9, var, n) == (2.25, 0.6875, 16 / 6)


def test_folded_names_by_either_way(spark):
    names = ["Café №1 ", "ＡＢ-c", "가나 12!", "ﬁx", "", None, "x_y", "é", "İ"]
    df = text.with_folded_name(spark.createDataFrame([(n,) for n in names], "n string"), "n", "f").withColumn("g", text.folded_name(F.col("n")))
    assert all(r.f == r.g for r in df.collect())


def test_plan_of_the_backtest_stays_small(spark):
    from tessera import catalog

    df = catalog.QUERIES["nowcast_gates"](spark, "/root/testdata/sf0.001")
    filters = [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in line]
    assert all(len(line) < 2000 for line in filters)


def test_one_radius_join_makes_scores_and_contributors(spark):
    from tessera import catalog

    df = catalog.QUERIES["materialize_scores"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("_cx") < 25


def test_history_that_teaches_nothing(spark):
    day = date(2024, 1, 1)
    rows = [("a", day, 1, False, 1.0), ("b", day, 24, False, 1.0), ("c", day, 1, True, 1.0), ("d", day, 1, False, None), ("e", day, 1, False, -1.0), ("f", day, 1, True, None), ("f", day, 1, False, 2.0), (None, day, 1, True, None), ("g", day, 1, False, float("nan"))]
    df = spark.createDataFrame(rows, "cell_id string, observed_date date, hour int, masked boolean, value double")
    got = sorted((r.cell_id or "", r.fault) for r in baseline.history_faults(df).collect())
    assert got == [("", "cell"), ("b", "hour"), ("c", "masked_with_value"), ("d", "no_value"), ("e", "value"), ("f", "repeated"), ("f", "repeated"), ("g", "value")]


def test_plans_and_shortages(spark):
    from tessera.operators import audit

    old = spark.createDataFrame([(1, "a", 0.0), (2, "b", 0.0), (3, "c", 0.0)], "id int, name string, at double")
    new = spark.createDataFrame([(1, "a", 0.0), (2, "x", 90.0), (4, "d", 0.0)], "id int, new_name string, to double")
    moved = F.abs(F.col("at") - F.col("to"))
    plan = audit.refresh_plan(old, new, "id", {"names": audit.differs(F.col("name"), F.col("new_name"))}, moved).first().asDict()
    assert plan == {"matched": 2, "changed": 1, "unchanged": 1, "names": 1, "large_moves": 1, "missing": 1, "added": 1}
    assert [r.id for r in audit.top_moves(old.join(new, "id"), moved, "id", 1).collect()] == [2]
    rows = spark.createDataFrame([("h", "near", 1), ("h", "near", 2), ("h", "near", 3), ("h", "mid", 4)], "h string, band string, c int")
    chosen = audit.best_by_band(rows, "h", "band", [F.desc("c")], 2)
    assert sorted((r.band, r.c, r.place) for r in chosen.collect()) == [("mid", 4, 1), ("near", 2, 2), ("near", 3, 1)]
    groups = spark.createDataFrame([("h",), ("i",)], "h string")
    short = audit.shortages(chosen, groups, "h", "band", ["near", "mid"], 2).collect()
    assert sorted(tuple(r) for r in short) == [("h", "mid", 1, 2), ("i", "mid", 0, 2), ("i", "near", 0, 2)]
    counts = audit.rule_counts(spark.createDataFrame([(1,), (7,), (None,)], "v int"), {"small": "v < 5", "known": "v IS NOT NULL"}, "t").collect()
    assert [tuple(r) for r in counts] == [("t", "small", 1), ("t", "known", 1)]


def test_nearest_are_found_once_for_each_spot(spark):
    spots = [(37.5 + i * 0.002, 127.0) for i in range(6)]
    points = spark.createDataFrame([(10 * j + i, *p) for i, p in enumerate(spots) for j in range(4)], "cafe_id bigint, lat double, lng double")
    places = spark.createDataFrame([(10 * j + i, p[0] + 0.001, p[1]) for i, p in enumerate(spots) for j in range(5)], "hotspot_id bigint, p_lat double, p_lng double")
    near = spatial.nearest_at(points, places, "hotspot_id", 500.0, 3)
    want = spatial.nearest_k(spatial.radius_pairs(points, places, 500.0), "cafe_id", "hotspot_id", 3)
    rows = lambda df: sorted(map(tuple, df.select("cafe_id", "rank", "hotspot_id", "distance_m").collect()))
    assert rows(points.join(near, ["lat", "lng"])) == rows(want)
    assert near.count() == 18 and want.count() == 72  # the work follows the spots


def test_scores_are_made_once_for_each_spot(spark, monkeypatch):
    """Copies of cafes and hotspots at the same spots add no pairs, and no score changes."""
    cafes = spark.createDataFrame([(100 * j + i, 37.5 + i * 300 * NORTH, 127.0) for i in range(5) for j in range(6)], "cafe_id bigint, lat double, lng double")
    hotspots = spark.createDataFrame([(100 * j + i, 37.5 + (i * 400 + 50) * NORTH, 127.0, 1 + (i + j) % 4, NOW - timedelta(minutes=i + j)) for i in range(4) for j in range(7)], "hotspot_id bigint, p_lat double, p_lng double, level int, observed_at timestamp_ntz")
    one_by_one = scoring.weighted(spatial.nearest_k(spatial.radius_pairs(cafes, hotspots, 1500.0), "cafe_id", "hotspot_id", 3), ["cafe_id"])
    want = scoring.rated(cafes, one_by_one, ["cafe_id"], F.lit(NOW))
    seen, real = [], spatial.radius_pairs
    monkeypatch.setattr(spatial, "radius_pairs", lambda *a: seen.append(real(*a)) or seen[-1])
    rows = lambda df: sorted(map(tuple, df.withColumns({"score": F.round("score", 9), "confidence": F.round("confidence", 9)}).collect()))
    assert rows(scoring.score_points(cafes, hotspots, F.lit(NOW))) == rows(want)
    assert len(seen) == 1 and seen[0].count() == 5 * 4 * 3
