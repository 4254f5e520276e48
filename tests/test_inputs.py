"""Inputs with rules of their own, and sinks."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tessera.sources import inputs, outputs

HEADER = "cafe_id,observed_at,slot,observed_area_level,pedestrians_per_min,flow_obstruction,observer_notes,observer_id,observation_role,observed_venue_level\n"
GOOD = ["1,2024-01-31T12:00:00+09:00,s1,2,15,none,,ann,primary,", '2,2024-01-31T12:00Z, s1 ,3,4.5,repeated_avoidance,"a line\nand more",bob,reliability,4', "3,2024-01-31T12:00Z,s1,4,1,blocked,note,ann,primary,1"]
BAD = {
    "0,2024-01-31T12:00Z,s1,1,1,none,,ann,primary,": ["cafe_id"],
    "1,2024-01-31T12:00,s1,1,1,none,,ann,primary,": ["observed_at"],
    "1,2024-01-31T12:00Z,,1,1,none,,ann,primary,": ["slot"],
    "1,2024-01-31T12:00Z,s,5,31,none,,ann,primary,": ["observed_area_level", "evidence"],
    "1,2024-01-31T12:00Z,s,1,1,none,,ann,primary,9": ["observed_venue_level"],
    "1,2024-01-31T12:00Z,s,1,-1,none,,ann,primary,": ["pedestrians_per_min", "evidence"],
    "1,2024-01-31T12:00Z,s,4,1,blocked,,ann,primary,": ["observer_notes"],
    "1,2024-01-31T12:00Z,s,2,1,none,,ann,primary,": ["evidence"],
    "1,2024-01-31T12:00Z,s,1,1,none,,,other,": ["observer_id", "observation_role"],
}


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_truths(spark, tmp_path):
    good, bad = inputs.read_truths(spark, put(tmp_path / "t.csv", "\ufeff" + HEADER + "\n".join([*GOOD, *BAD]) + "\n"))
    rows = good.orderBy("cafe_id").collect()
    assert [(r.cafe_id, r.observed_at, r.slot, r.observed_area_level, r.observed_venue_level) for r in rows] == [(1, datetime(2024, 1, 31, 3), "s1", 2, None), (2, datetime(2024, 1, 31, 12), "s1", 3, 4), (3, datetime(2024, 1, 31, 12), "s1", 4, 1)]
    assert sorted(r.errors for r in bad.collect()) == sorted(BAD.values())
    with pytest.raises(ValueError, match="slot"):
        inputs.read_truths(spark, put(tmp_path / "u.csv", HEADER.replace("slot,", "") + "1\n"))


def test_faults_in_the_structure_of_truths(spark):
    rows = [(1, "a", "x", "primary"), (1, "a", "y", "reliability"), (2, "a", "x", "primary"), (2, "a", "x", "reliability"), (3, "a", "x", "reliability"), (4, "a", "x", "primary"), (4, "a", "y", "reliability"), (4, "a", "z", "reliability")]
    df = spark.createDataFrame(rows, "cafe_id int, slot string, observer_id string, observation_role string")
    assert sorted((r.cafe_id, r.fault) for r in inputs.truth_faults(df).collect()) == [(2, "observer_twice"), (3, "not_one_primary"), (4, "several_reliability")]


def test_candidates(spark, tmp_path):
    path = put(tmp_path / "c.csv", "id,name,reviewed\n1,a,yes\n2,b,no\n3,c,\n4,d, YES \n")
    assert [r.id for r in inputs.read_candidates(spark, path, ["id", "name"]).orderBy("id").collect()] == ["1", "4"]
    with pytest.raises(Exception, match="not an answer"):
        inputs.read_candidates(spark, put(tmp_path / "d.csv", "id,reviewed\n1,perhaps\n"), ["id"]).collect()


def test_calendar_and_centroids(spark, tmp_path):
    calendar = {"from": "2024-01-01", "to": "2024-12-31", "holidays": [{"date": "2024-01-01", "name": "a"}, {"date": "2024-02-09", "name": "b"}]}
    assert inputs.read_calendar(spark, put(tmp_path / "a.json", json.dumps(calendar, indent=1))) == [date(2024, 1, 1), date(2024, 2, 9)]
    for days in (["2025-01-01"], ["2024-02-09", "2024-01-01"], ["2024-01-01", "2024-01-01"]):
        bad = calendar | {"holidays": [{"date": d, "name": "x"} for d in days]}
        with pytest.raises(ValueError):
            inputs.read_calendar(spark, put(tmp_path / "b.json", json.dumps(bad)))
    places = {"schema": 1, "crs": "EPSG:4326", "centroids": {"11020": [127.0, 37.5], "11010": [126.9, 37.6]}}
    assert [tuple(r) for r in inputs.read_centroids(spark, put(tmp_path / "c.json", json.dumps(places))).orderBy("zone_id").collect()] == [("11010", 37.6, 126.9), ("11020", 37.5, 127.0)]
    for change in ({"crs": "EPSG:5179"}, {"schema": 2}, {"centroids": {"x": [0, 0]}}, {"centroids": {"1": [0, 91]}}):
        with pytest.raises(ValueError):
            inputs.read_centroids(spark, put(tmp_path / "d.json", json.dumps(places | change)))


def test_places_are_narrowed_by_the_scan(spark, tmp_path, capsys):
    kind = "id string, names struct<primary:string>, categories struct<primary:string>, confidence double, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>, addresses array<struct<freeform:string>>, phones array<string>, other string"
    row = lambda i, c, conf, x, a: (i, (f"n{i}",), (c,), conf, (x, x, 37.5, 37.5), a, [], "wide")
    rows = [row("1", "cafe", 0.9, 127.0, [("road 1",), ("road 2",)]), row("2", "cafe", 0.2, 127.0, []), row("3", "bar", 0.9, 127.0, None), row("4", "cafe", 0.9, 128.0, None), row("5", "cafe", None, 127.0, None)]
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "p"))
    box = (126.8, 37.4, 127.2, 37.7)
    df = inputs.read_places(spark, str(tmp_path / "p"), box, "cafe", 0.5)
    assert [tuple(r) for r in df.collect()] == [("1", "n1", "road 1", None, "cafe", 0.9, 37.5, 127.0)]
    assert {r.id for r in inputs.read_places(spark, str(tmp_path / "p"), box, "cafe").collect()} == {"1", "2", "5"}
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    df.explain("formatted")
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    plan = capsys.readouterr().out
    schema = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "other" not in schema and "GreaterThanOrEqual(bbox.xmin" in plan and "EqualTo(categories.primary" in plan


def test_text_sinks(spark, tmp_path):
    assert outputs.canonical_json({"b": [1.5, None], "a": "카페"}) == '{"a":"카페","b":[1.5,null]}'
    with pytest.raises(ValueError):
        outputs.canonical_json(float("nan"))
    for text in ("first", "second"):
        outputs.write_text(spark, str(tmp_path / "x.json"), text)
    assert (tmp_path / "x.json").read_text() == "second" and not (tmp_path / "x.json.part").exists()
    df = spark.createDataFrame([(2, 1.005, "a|b"), (1, None, None), (3, -2.5, "c")], "k int, v double, t string")
    outputs.write_csv(df, str(tmp_path / "c"), {"v": 1}, ["k"])
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "c")).orderBy("k").collect()] == [("1", None, None), ("2", "1.0", "a|b"), ("3", "-2.5", "c")]
    assert outputs.markdown_table(df, ["k"]) == "| k | v | t |\n| - | - | - |\n| 1 |  |  |\n| 2 | 1.005 | a\\|b |\n| 3 | -2.5 | c |\n"
    with pytest.raises(ValueError):
        outputs.markdown_table(df, ["k"], 2)


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "c"), (None, "m")], "k int, v string")
    out = outputs.upsert(old, new, ["k"])
    assert sorted((r.k or 0, r.v or "") for r in out.collect()) == [(0, "m"), (1, "a"), (2, ""), (3, "c")]
    assert outputs.upsert(old, new.limit(0), ["k"]).count() == 3 and outputs.upsert(old.limit(0), new, ["k"]).count() == 3
    with pytest.raises(Exception, match="twice"):
        outputs.upsert(old, new.union(new.where(F.col("k") == 3)), ["k"]).collect()
