"""Components, stations, exits and stitched lines against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import stations, tracks
from tessera.operators.components import components

POINTS = "array<struct<lng:double,lat:double>>"


def plain_roots(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 260)] + [(1000, x) for x in range(1001, 1400)] + [(rnd.randrange(3000, 3400), rnd.randrange(3000, 3400)) for _ in range(150)] + [(7, 7)]
    rnd.shuffle(edges)
    df = spark.createDataFrame([*edges, (None, 3), (8, None)], "u bigint, v bigint")
    assert {r.node: r.root for r in components(df).collect()} == plain_roots(edges)
    assert components(df.limit(0)).count() == 0


def metres(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * stations.RADIUS_M * math.asin(min(1, math.sqrt(h)))


def test_clusters_are_those_of_all_pairs(spark):
    rnd = random.Random(1)
    stops = [(i, rnd.choice(["a", "b"]), lat + rnd.uniform(0, 0.05), 127 + rnd.uniform(0, 0.05)) for i, lat in enumerate([37.5] * 300 + [-59.0] * 100 + [0.0] * 100)]
    stops += [(1000 + i, "hot", 37.5, 127.0) for i in range(2000)]  # one name, one place
    edges = [(a[0], b[0]) for a in stops[:500] for b in stops[:500] if a[1] == b[1] and metres(a[2:], b[2:]) <= 350] + [(1000, x[0]) for x in stops[500:]]
    df = spark.createDataFrame([*stops, (9000, "a", None, None), (9001, None, 37.5, 127.0)], "stop_id bigint, name string, lat double, lng double")
    got = {r.stop_id: r.station_id for r in stations.cluster_stops(df).collect()}
    assert got == plain_roots(edges) | {9000: 9000, 9001: 9001}
    with pytest.raises(ValueError):
        stations.near_stops(df.withColumn("key", F.lit("")), 350.0, 90.0)


def test_stations_have_modal_names_and_mean_places(spark):
    rows = [(3, "Bridge", "2", 37.5, 127.0), (1, "bridge 역", "1", 37.501, 127.0), (2, "Bridge", "2", 37.5005, 127.001), (9, "Bridge", "9", 37.6, 127.0), (8, "Brid ge", "9", 37.6, 127.0)]
    df = spark.createDataFrame(rows, "stop_id bigint, name string, line string, lat double, lng double")
    got = {r.station_id: tuple(r)[1:] for r in stations.build_stations(df).collect()}
    assert got == {1: ("Bridge", ["1", "2"], 3, 8, 37.5005, 127.000333), 8: ("Bridge", ["9"], 2, 9, 37.6, 127.0)}


def test_exits_go_to_the_station_that_they_name(spark):
    places = spark.createDataFrame([(1, "Alpha", 37.5, 127.0), (2, "Beta", 37.5, 127.001), (3, "alpha 역", 37.52, 127.0)], "station_id bigint, name string, lat double, lng double")
    rows = [(10, "3", "alpha exit", 37.5, 127.0009), (11, None, "Beta 4번 출구", 37.5, 127.0), (12, "x", "no number", 37.5, 127.0), (13, "1", "gamma", 37.5, 127.0), (14, "2", "Alpha", 37.6, 127.0), (9, "3", "ALPHA", 37.5, 127.0009), (15, "3", "alpha", None, None), (16, "1", "gamma", 37.5, 127.0)]
    df = spark.createDataFrame(rows, "exit_id bigint, ref string, label string, lat double, lng double")
    got = {r.exit_id: (r.station_id, r.exit_no) for r in stations.named_exits(df, places).collect()}
    assert got == {9: (1, "3"), 11: (2, "4"), 13: (None, "1"), 14: (None, "2"), 16: (None, "1")}


def test_runs_between_gaps(spark):
    p = [(1.0, 1.0), (1.0, 1.0), (2.0, 2.0), None, None, (3.0, 3.0), None, (4.0, 4.0), (99.0, 4.0), (5.0, 5.0), (6.0, 6.0)]
    df = spark.createDataFrame([(p,), ([],), (None,), ([None],)], f"p {POINTS}")
    got = [r[0] for r in df.select(tracks.runs(F.col("p"), lambda x: x.lng < 50)).collect()]
    assert [[[tuple(x) for x in run] for run in runs] if runs is not None else None for runs in got] == [[[(1.0, 1.0), (2.0, 2.0)], [(5.0, 5.0), (6.0, 6.0)]], [], None, []]


def points(*ids):
    return [(float(i), float(i % 7)) for i in ids]


def stitched(spark, parts):
    rows = tracks.stitched(spark.createDataFrame(parts, f"line_id string, points {POINTS}")).collect()
    return sorted((r.line_id, [int(p.lng) for p in r.points], r.parts, r.closed) for r in rows)


def test_stitching_of_paths_branches_and_rings(spark):
    rnd = random.Random(3)
    path = list(range(0, 1001))
    rnd.shuffle(order := list(range(1000)))
    parts = [("long", points(*((path[i], path[i + 1])[:: rnd.choice([1, -1])]))) for i in order]
    ring = [50, 53, 51, 52, 50]
    parts += [("ring", points(ring[i + 1], ring[i]) if i % 2 else points(ring[i], ring[i + 1])) for i in (2, 0, 3, 1)]
    parts += [("loop", points(5, 3, 4, 5)), ("star", points(1, 2)), ("star", points(3, 2)), ("star", points(2, 4, 5)), ("star", points(5, 6)), ("star", points(6, 5))]
    parts += [("two", points(1, 2)), ("other", points(2, 3)), ("eight", points(1, 2, 3, 1)), ("eight", points(1, 4, 5, 1)), ("dot", points(1))]
    got = stitched(spark, parts)
    assert got == sorted([
        ("long", path, 1000, False),
        ("ring", [50, 52, 51, 53, 50], 4, True),
        ("loop", [3, 4, 5, 3], 1, True),
        ("star", [1, 2], 1, False),
        ("star", [2, 3], 1, False),
        ("star", [2, 4, 5, 6], 2, False),
        ("two", [1, 2], 1, False),
        ("other", [2, 3], 1, False),
        ("eight", [1, 2, 3, 1], 1, True),
        ("eight", [1, 4, 5, 1], 1, True),
    ])
    assert stitched(spark, []) == []


def test_parts_of_lines(spark):
    members = spark.createDataFrame([("a", 1, "subway"), ("a", 1, "subway"), ("a", 2, "bus"), ("b", 1, "subway"), ("b", 9, "subway")], "line_id string, way_id int, route string")
    ways = spark.createDataFrame([(1, [(2.0, 0.0), (1.0, 0.0)]), (2, [(5.0, 0.0), (6.0, 0.0)])], f"way_id int, points {POINTS}")
    got = tracks.line_parts(members, ways, F.col("route") == "subway").collect()
    assert sorted((r.line_id, [p.lng for p in r.points]) for r in got) == [("a", [1.0, 2.0]), ("b", [1.0, 2.0])]
