"""Files, catalogues, paged sources and streams."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import files
from tessera.sources.paged import PagedSource
from tessera.streaming import snapshots


def test_korean_csv_with_masks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("일자,생활인구합계\n20240101,12.5\n20240101,*\n20240102,1.234567\n".encode("cp949"))
    df = files.read_csv(spark, str(tmp_path / "a.csv"), ["일자", "생활인구합계"], "cp949")
    value, masked = files.masked_value(F.col("생활인구합계"))
    assert [(str(r.v), r.m) for r in df.select(value.alias("v"), masked.alias("m")).collect()] == [("12.50000", False), ("None", True), ("None", False)]
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "a.csv"), ["일자"], "cp949")
    assert files.read_csv(spark, str(tmp_path / "a.csv"), ["일자"], "cp949", extra=True).count() == 3


def test_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.csv", "a,b\r\n1,2\r\n")
    assert [(r.line_no, r.line) for r in files.read_zip_csv(spark, str(tmp_path / "a.zip")).collect()] == [(0, "a,b"), (1, "1,2")]


def test_area_json(spark):
    rows = [json.dumps({"AREA_CD": "POI001", "AREA_CONGEST_LVL": "약간 붐빔", "AREA_PPLTN_MIN": "100", "AREA_PPLTN_MAX": "x", "PPLTN_TIME": "2024-01-01 09:30", "FCST_PPLTN": [{"FCST_TIME": "2024-01-01 10:00"}]}), "nonsense"]
    got = spark.createDataFrame([(r,) for r in rows], "raw string").select(files.parse_area(F.col("raw")).alias("a")).select("a.*", F.col("a.observed_at").cast("string").alias("t")).collect()
    assert (got[0].area_cd, got[0].level, got[0].ppltn_min, got[0].ppltn_max, got[0].t) == ("POI001", 3, 100, None, "2024-01-01 00:30:00")
    assert got[1].area_cd is None and got[1].level is None
    good, bad = files.quarantine(spark.createDataFrame([(1, 5), (2, None), (9, 7)], "level int, n int"), {"level": F.col("level") <= 4, "n": F.col("n") > 0})
    assert good.collect() == [(1, 5)] and {tuple(r.errors) for r in bad.collect()} == {("n",), ("level",)}


def test_exact_columns(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "p"))
    schema = T.StructType([T.StructField("id", T.LongType())])
    assert files.read_exact_parquet(spark, str(tmp_path / "p"), schema).count() == 3
    with pytest.raises(ValueError):
        files.read_exact_parquet(spark, str(tmp_path / "p"), schema.add("x", T.LongType()))


def test_catalogue_is_bound_to_its_manifest(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "id bigint, name string")
    path = str(tmp_path / "c")
    assert files.write_catalogue(df, path, "id")["count"] == 2
    assert files.read_catalogue(spark, path, "id bigint, name string").count() == 2
    with pytest.raises(FileExistsError):
        files.publish(df, f"{path}/rows", "json")
    (next((tmp_path / "c/rows").glob("part-*.json"))).write_text('{"id":1,"name":"z"}\n')
    for crc in (tmp_path / "c/rows").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError):
        files.read_catalogue(spark, path, "id bigint, name string")
    with pytest.raises(ValueError):
        files.digest(df.union(df), "id")


def test_geojson(spark):
    df = spark.createDataFrame([(1, 37.5, 127.0)], "id int, lat double, lng double")
    assert json.loads(files.geojson(df, "lat", "lng", ["id"]).first()[0]) == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [127.0, 37.5]}, "properties": {"id": 1}}


def numbers(page, size):
    return 7, [{"n": i} for i in range(7)][page * size : (page + 1) * size]


def short(page, size):
    return 7, []


def test_pages(spark):
    spark.dataSource.register(PagedSource)
    read = lambda f: spark.read.format("paged").option("fetch", f"test_sources:{f}").option("size", 3).load()
    assert sorted((r.page, json.loads(r.row)["n"]) for r in read("numbers").collect()) == [(i // 3, i) for i in range(7)]
    with pytest.raises(Exception, match="has 0 rows"):
        read("short").collect()


@pytest.fixture
def arriving(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("long").alias("user_id"), "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    events.limit(50).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # repeated
    return events, str(tmp_path / "in"), tmp_path


def test_stream_inserts_each_key_once(spark, arriving):
    events, path, tmp = arriving
    called = []
    for _ in range(2):
        snapshots.start(snapshots.read_events(spark, path), str(tmp / "cp"), snapshots.insert_new(str(tmp / "out"), ["event_id"], lambda d: called.append(d.count()), part=None)).awaitTermination(120)
    out = spark.read.parquet(str(tmp / "out"))
    assert out.count() == events.count() == out.select("event_id").distinct().count() and called[-1] == events.count()
    good, bad = snapshots.split_valid(spark.read.parquet(path), F.col("value") > 10)
    assert good.count() + bad.count() == events.count() + 50 and json.loads(bad.first().raw)["value"] <= 10


def run(stream, mode, name, tmp):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp / name)).trigger(availableNow=True).start().awaitTermination(120)
    return stream.sparkSession.table(name)


def test_stream_state_equals_batch(spark, arriving):
    events, path, tmp = arriving
    batch = snapshots.latest_state(spark.read.parquet(path), "user_id")
    assert sorted(map(tuple, run(snapshots.latest_state(snapshots.read_events(spark, path), "user_id"), "complete", "latest", tmp).collect())) == sorted(map(tuple, batch.collect()))
    limited = run(snapshots.limited(snapshots.read_events(spark, path), 3600, 2), "complete", "limited", tmp)
    assert limited.agg(F.sum("n")).first()[0] == events.count() + 50 and limited.agg(F.max("accepted")).first()[0] <= 2
    firsts = run(snapshots.first_writes(snapshots.read_events(spark, path), ["event_id"], horizon="90 days"), "append", "firsts", tmp)
    assert firsts.count() == events.count()
    windows = run(snapshots.windowed_counts(snapshots.read_events(spark, path), "1 day", "90 days"), "append", "windows", tmp)
    assert windows.columns == ["start", "event_type", "n", "total"]


def test_records_at_any_depth(spark):
    from tessera.sources.files import find_record, parse_area

    area = {"AREA_CD": "P1", "AREA_CONGEST_LVL": "보통", "AREA_PPLTN_MIN": "1", "AREA_PPLTN_MAX": "2", "PPLTN_TIME": "2024-01-01 09:00"}
    texts = [json.dumps(area), json.dumps({"a": [{"AREA_CD": "x"}, {"b": {"c": [area | {"AREA_CD": "P2"}, area]}}]}), "[]", "{", None, json.dumps({"AREA_CD": "P1"})]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", parse_area(find_record(F.col("t"))).alias("a"))
    assert [r.a.area_cd if r.a else None for r in df.orderBy("i").collect()] == ["P1", "P2", None, None, None, None]
