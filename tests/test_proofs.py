"""Strict resolution, gates, catalogues in stages, fragments and artefacts."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.operators import fragments, resolution
from tessera.sources import artifacts, outputs

PLACE = "name string, address string, phone string, lat double, lng double"
AT = "서울특별시 강남구 테헤란로 12"


def test_resolution_by_address_and_name_or_phone(spark):
    permits = [(1, "Cafe", AT, "02-555-1234", 37.5, 127.0), (2, "Tea", AT, "02-555-9999", 37.5, 127.0), (3, "Far", AT, None, 37.6, 127.0), (4, "Twin", AT, None, 37.5, 127.0), (5, "twin", f"서울 강남구 테헤란로 12 (((a) b) c)", None, 37.5, 127.0), (6, "Many", AT, None, 37.5, 127.0), (7, "Cafe", "서울 강남구 테헤란로 12-1", None, 37.5, 127.0), (8, None, None, None, 37.5, 127.0), (9, "Tea", AT, "call 5559999", 37.5, 127.0)]
    cafes = [(10, "CAFE", f"서울시  강남구 테헤란로 12, 3층", "02 555 1234", 37.5, 127.0), (11, "x", AT, "(02)5559999", 37.5003, 127.0), (12, "far", AT, None, 37.5, 127.0), (13, "twin", AT, None, 37.5, 127.0), (14, "many", AT, None, 37.5, 127.0), (15, "many", AT, None, 37.5, 127.0), (16, "cafe", "서울 강남구 다른로 12", None, 37.5, 127.0)]
    p = spark.createDataFrame(permits, f"permit_id int, {PLACE}")
    c = spark.createDataFrame(cafes, f"cafe_id int, {PLACE}")
    got = {r.permit_id: (r.status, r.cafe_id, r.rule, r.strong, r.collides) for r in resolution.resolve_strictly(p, c).collect()}
    assert got == {
        1: ("verified", 10, "both", 1, False),
        2: ("verified", 11, "phone_only", 1, False),
        3: ("missing", None, None, 0, False),
        4: ("ambiguous", None, None, 1, True),
        5: ("ambiguous", None, None, 1, True),
        6: ("ambiguous", None, None, 2, False),
        7: ("missing", None, None, 0, False),
        8: ("missing", None, None, 0, False),
        9: ("missing", None, None, 0, False),
    }
    assert resolution.resolve_strictly(p, c.limit(0)).where("status <> 'missing'").count() == 0


def test_gates_leave_out_the_permits_own_source(spark):
    p = spark.createDataFrame([(1, "a", AT, "02-555-1234", 37.5, 127.0), (2, "b", AT, None, 37.5, 127.0)], f"permit_id int, {PLACE}")
    c = spark.createDataFrame([(10, "A", AT, "025551234", 37.5, 127.0, "other"), (11, "a", AT, None, 37.5, 127.0, "own"), (12, "z", None, None, 37.5004, 127.0, None)], f"cafe_id int, {PLACE}, origin_provider string")
    got = {r.gate: (r.pairs, r.permits) for r in resolution.gate_funnel(resolution.gate_masks(p, c, "own")).collect()}
    assert len(got) == 11 and got["actual_within_distance_gate"] == (4, 2) and got["exact_normalized_name_within_distance_gate"] == (1, 1)
    assert got["exact_structured_address_within_distance_gate"] == (2, 2) and got["exact_structured_address_and_phone_within_distance_gate"] == (1, 1)
    empty = resolution.gate_funnel(resolution.gate_masks(p.limit(0), c, "own")).collect()
    assert [(r.pairs, r.permits) for r in empty] == [(0, 0)] * 11


def test_eligible_areas(spark):
    rows = [("coffee", "eligible", "m2", "sure", "12.5"), ("coffee", "eligible", "m2", "sure", "0"), ("coffee", "eligible", "m2", "sure", "x"), ("tea", "eligible", "m2", "sure", "5"), (None, "eligible", "m2", "sure", "5")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    got = df.select(resolution.eligible_area(*(F.col(x) for x in "abcde"), wanted=("coffee", "eligible", "m2", "sure"))).collect()
    assert [r[0] for r in got] == [Decimal("12.5"), None, None, None, None]


RAW = "date_raw string, hour_raw string, administrative_dong_code string, cell_id string, total_raw string, source_file string"
GOOD = ("20240101", "07", "11110000", "다사00250050", "12.5", "a.csv")


def test_every_fault_of_a_row_is_counted(spark):
    bad = {"date": (0, "20240230"), "hour": (1, "24"), "administrative_dong_code": (2, "1111000"), "cell_id": (3, "다사00260050"), "total": (4, "-1"), "fraction_scale": (4, "1.000001")}
    for name, (i, value) in bad.items():
        for v in (value, None) if name != "fraction_scale" else (value,):
            row = spark.createDataFrame([GOOD, (*GOOD[:i], v, *GOOD[i + 1 :])], RAW)
            counts = {k: n for k, n in fragments.count_faults(row).first().asDict().items() if n}
            assert counts == {"total_rows": 2, f"invalid_{name}": 1}
            with pytest.raises(ValueError, match=name):
                fragments.compact_strictly(row, spark.createDataFrame([("다사99999999",)], "cell_id string"))
    fine = spark.createDataFrame([GOOD, (*GOOD[:4], "3.", "b.csv")], RAW)
    assert not any(n for k, n in fragments.count_faults(fine).first().asDict().items() if k != "total_rows")


def cells(spark):
    rows = [GOOD, (*GOOD[:2], "11110001", GOOD[3], "*", "a.csv"), ("20240101", "08", "11110000", GOOD[3], "*", "a.csv"), (*GOOD[:3], "다사00500050", "7.00001", "b.csv")]
    return spark.createDataFrame(rows, RAW), spark.createDataFrame([(GOOD[3],), (GOOD[3],)], "cell_id string")


def test_strict_compaction(spark):
    rows, allowed = cells(spark)
    made, counts = fragments.compact_strictly(rows, allowed)
    got = {r.hour: r for r in made.collect()}
    assert len(got) == 2 and got[7].known_total == Decimal("12.50000") and (got[7].fragment_count, got[7].masked_fragment_count) == (2, 1) and got[8].known_total == 0
    assert got[7].fragments_json == '[{"administrative_dong_code":"11110000","known_value":"12.50000","total_raw":"12.5","masked":false,"source_file":"a.csv"},{"administrative_dong_code":"11110001","known_value":null,"total_raw":"*","masked":true,"source_file":"a.csv"}]'
    assert counts.first().asDict() == {"input_rows": 4, "fragments": 3, "masked_fragments": 2, "cell_hours": 2, "multi_fragment": 1, "partially_masked": 1, "all_masked": 1, "most_fragments": 2}
    with pytest.raises(ValueError, match="stands in 2 rows"):
        fragments.compact_strictly(rows.union(rows.limit(1)), allowed)
    with pytest.raises(ValueError, match="1 allowed cells"):
        fragments.compact_strictly(rows, allowed.union(spark.createDataFrame([("다사99759975",)], "cell_id string")))
    assert {tuple(r.faults) for r in fragments.verify(made).collect()} == {()}


def test_every_fault_of_fragments_is_named(spark):
    rows, allowed = cells(spark)
    one = fragments.compact(rows, allowed).where("hour = 7")
    text = one.first().fragments_json
    first, second = text[1:-1].split("},{")
    changes = {
        "known_total": ("known_total", F.lit(-1)),
        "counts": ("fragment_count", F.lit(0)),
        "fragment_count": ("fragment_count", F.lit(3)),
        "masked_count": ("masked_fragment_count", F.lit(2)),
        "sum": ("known_total", F.lit(13)),
        "json": ("fragments_json", F.lit("[{")),
        "canonical_json": ("fragments_json", F.lit(text.replace(",", ", "))),
        "fields": ("fragments_json", F.lit(text.replace('"source_file":"a.csv"}', '"source_file":"a.csv","more":1}'))),
        "code": ("fragments_json", F.lit(text.replace("11110000", "1111000x"))),
        "source_file": ("fragments_json", F.lit(text.replace("a.csv", " a.csv"))),
        "masked_value": ("fragments_json", F.lit(text.replace('"known_value":null', '"known_value":"1"'))),
        "unmasked_value": ("fragments_json", F.lit(text.replace('"12.5"', '"12,5"'))),
        "value_is_total": ("fragments_json", F.lit(text.replace('"12.5"', '"12.6"'))),
        "order": ("fragments_json", F.lit("[{" + second.rstrip("}") + "},{" + first.lstrip("{") + "}]")),
    }
    assert set(changes) == set(fragments.cell_faults())
    for name, (column, value) in changes.items():
        kind = one.schema[column].dataType
        assert name in fragments.verify(one.withColumn(column, value.cast(kind))).first().faults, name


def table(spark):
    return spark.createDataFrame([(1, "a"), (2, None)], "id bigint, v string")


def test_pairs_are_published_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    at = f"{tmp_path}/out"
    manifest = artifacts.publish_pair(table(spark), at, "id", {"day": "2024-01-09"})
    df, held = artifacts.read_pair(spark, at)
    assert held == manifest and held["rows"] == 2 and held["about"] == {"day": "2024-01-09"} and df.count() == 2
    with pytest.raises(FileExistsError):
        artifacts.publish_pair(table(spark), at, "id", {})
    assert artifacts.read_pair(spark, at)[1] == manifest and not artifacts.recover(spark, at)

    real = artifacts.rename

    def second_fails(spark, source, target):
        if target.endswith(artifacts.MANIFEST):
            raise OSError("no")
        real(spark, source, target)

    monkeypatch.setattr(artifacts, "rename", second_fails)
    with pytest.raises(OSError, match="no"):
        artifacts.publish_pair(table(spark), f"{at}2", "id", {})
    assert not list(tmp_path.glob("out2*"))


def test_what_a_crash_leaves_is_no_artefact(spark, tmp_path, monkeypatch):
    """The process ends between the two renames: nothing of what follows is run."""
    at = f"{tmp_path}/out"
    real_rename, real_remove = artifacts.rename, artifacts.remove

    class Crash(BaseException):
        pass

    def dies(spark, source, target):
        if target.endswith(artifacts.MANIFEST):
            monkeypatch.setattr(artifacts, "remove", lambda *_: None)
            raise Crash
        real_rename(spark, source, target)

    monkeypatch.setattr(artifacts, "rename", dies)
    with pytest.raises(Crash):
        artifacts.publish_pair(table(spark), at, "id", {})
    monkeypatch.setattr(artifacts, "rename", real_rename)
    monkeypatch.setattr(artifacts, "remove", real_remove)
    with pytest.raises(FileNotFoundError):
        artifacts.read_pair(spark, at)
    with pytest.raises(FileExistsError):
        artifacts.publish_pair(table(spark), at, "id", {})
    assert artifacts.recover(spark, at) and not list(tmp_path.glob("out*"))
    artifacts.publish_pair(table(spark), at, "id", {})
    # rows that go missing are seen
    next((tmp_path / "out").glob("*.parquet")).unlink()
    with pytest.raises(ValueError):
        artifacts.read_pair(spark, at)


def test_texts_are_replaced_or_refused(spark, tmp_path):
    at = f"{tmp_path}/t.json"
    artifacts.write_new_text(spark, at, "one")
    with pytest.raises(FileExistsError):
        artifacts.write_new_text(spark, at, "two")
    assert open(at).read() == "one"
    outputs.write_text(spark, at, "three")
    assert open(at).read() == "three" and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["t.json"]
