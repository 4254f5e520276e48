"""Addresses, codes and times in their odd forms."""

import unicodedata
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import address, timing

ADDRESSES = {
    "서울특별시 마포구 양화로 12": ("마포구", "양화로", 12, None),
    "서울 마포구 양화로12-3 (서교동, 2층)": ("마포구", "양화로", 12, 3),
    "서울시 종로구 종로3길 5, 지하1층 101호": ("종로구", "종로3길", 5, None),
    "서울  중구　세종대로 １１０ (태평로1가 (신관))": ("중구", "세종대로", 110, None),
    "서울 중구 세종대로 110 B1층": ("중구", "세종대로", 110, None),
    "서울 중구 세종대로 110 ((((a) b) (c)) d), 3층 (e)": ("중구", "세종대로", 110, None),
    "서울시 마포구 월드컵로12길 3-4 제 2동 101호": ("마포구", "월드컵로12길", 3, 4),
    "서울 중구 세종대로 110 ((a)": None,
    "서울 중구 세종대로 110 a)(b": None,
    "서울 중구 세종대로 110 (( ))": None,
    "서울 중구 세종대로 110 ()": None,
    "서울 중구 세종대로 110 (태평로": None,
    "서울 중구 세종대로 110,": None,
    "서울 중구 세종대로 110 카페": None,
    "서울 가나구 세종대로 110": None,
    "부산 중구 세종대로 110": None,
    "서울 중구 세종대로 0": None,
    "": None,
    None: None,
}
CORES = {"서울특별시 마포구 양화로 12-3": "양화로123", "마포구 양화로 12": "양화로12", "양화로 12, A동": "양화로12a동", "서울 마포구": None, "12-3": None, "양화로": None, "": None, None: None, "ＡＢ ①2": "ab12"}


def test_addresses(spark):
    df = address.with_entity_text(spark.createDataFrame([(t,) for t in ADDRESSES], "t string"), "t", "e")
    got = {r.t: r.a and tuple(r.a) for r in df.withColumn("a", address.road_address(F.col("e"))).collect()}
    assert got == ADDRESSES
    df = address.with_entity_text(spark.createDataFrame([(t,) for t in CORES], "t string"), "t", "e")
    assert {r.t: r.c for r in df.withColumn("c", address.address_core(F.col("e"))).collect()} == CORES


def test_entity_text(spark):
    texts = ["A  b", " ﬁ Ⅷ ", "ＣＡＦＥ　x", "가나 다", "Straße", "가", "İ", "", " ", None, "tab\there"]
    df = address.with_entity_text(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "e")
    plain = lambda t: t and (" ".join(unicodedata.normalize("NFKC", t).casefold().split()) or None) or None
    assert {r.t: r.e for r in df.collect()} == {t: plain(t) for t in texts}


def test_names_and_numbers(spark):
    rows = [("서울 역", "3", None), ("City Hall", " 3-1 ", "x"), ("역삼", "A", "입구 12번 출구"), ("역역", None, "7-1 출입구"), ("x", "123", "no")]
    df = spark.createDataFrame(rows, "n string, r string, t string")
    out = df.select(address.station_name(F.col("n")).alias("n"), address.exit_number(F.col("r"), F.col("t")).alias("x"), address.truncated(F.col("n"), 2).alias("c")).collect()
    assert [tuple(r) for r in out] == [("서울", "3", "서울"), ("cityhall", "3-1", "Ci"), ("역삼", "12", "역삼"), ("역", "7-1", "역역"), ("x", None, "x")]


def test_forms(spark):
    good = {"date": ["20240229"], "hour": ["00", "23"], "code": ["11010530"], "cell": ["다사12345678"], "decimal": ["0", "1.25"]}
    bad = {"date": ["20230229", "2024022", "20241301"], "hour": ["24", "7"], "code": ["1101053", "1101053x"], "cell": ["다12345678", "다사1234567"], "decimal": ["-1", "1.", ".5", "1e3"]}
    for form in address.FORMS:
        df = spark.createDataFrame([(t, True) for t in good[form]] + [(t, False) for t in [*bad[form], "", None]], "t string, want boolean")
        assert df.where(address.well_formed(F.col("t"), form) != F.col("want")).count() == 0, form


def test_times(spark):
    want = {"2024-01-31T12:00:00+09:00": datetime(2024, 1, 31, 3), "2024-01-31T12:00Z": datetime(2024, 1, 31, 12), "2024-01-31 12:00:00.5+0900": datetime(2024, 1, 31, 3, 0, 0, 500000), "2024-01-31T12:00:00": None, "2024-02-30T12:00:00Z": None, "x": None, None: None}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r.t: r.z for r in df.withColumn("z", timing.zoned_time(F.col("t"))).collect()} == want
    codes = {"07": 420, "0720": 440, "0710": None, "2340": 1420, "24": None, "": None, None: None}
    df = spark.createDataFrame([(t,) for t in codes], "t string")
    rows = df.withColumn("m", timing.flow_minute(F.col("t"))).withColumn("h", timing.hour_of(F.col("m"))).collect()
    assert {r.t: r.m for r in rows} == codes and {r.h for r in rows} == {7, 23, None}
    day = spark.sql("SELECT TIMESTAMP '2024-01-30 15:00:00' AS t").select(timing.local_day(F.col("t")).alias("d")).first().d
    assert day == date(2024, 1, 31)


def test_schedules_and_months():
    assert timing.minute_list(20, 7) == "7,27,47 * * * *"
    assert timing.months_between("202311", "202402") == ["202311", "202312", "202401", "202402"]
    for bad in ((7, 0), (0, 0), (20, 20), (20, -1)):
        with pytest.raises(ValueError):
            timing.minute_list(*bad)
    for bad in (("202313", "202401"), ("202402", "202401"), ("2024", "202401"), ("２０２４01", "202402")):
        with pytest.raises(ValueError):
            timing.months_between(*bad)
    with pytest.raises(ValueError):
        timing.months_between("202201", "202202", earliest="202301")


def test_day_types():
    # a Thursday, and a Monday after a weekend
    got = {d: t for d, _, t in timing.day_types(date(2024, 2, 1), date(2024, 2, 15), {date(2024, 2, 1), date(2024, 2, 12)})}
    assert got[date(2024, 2, 1)] == "public_holiday" and got[date(2024, 2, 2)] == "working_day"
    assert [got[date(2024, 2, i)] for i in (3, 4, 10, 11, 12, 13)] == ["saturday", "sunday", "long_holiday", "long_holiday", "long_holiday", "working_day"]
    assert got[date(2024, 2, 15)] == "working_day"
