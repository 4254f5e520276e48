"""Shapefiles and sheets, written here byte by byte, and areas with holes."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions.geo import inside_rings
from tessera.operators import geometry
from tessera.sources import areas

OUTER = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0)]  # clockwise
HOLE = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]
SECOND = [(6.0, 0.0), (6.0, 2.0), (8.0, 2.0), (8.0, 0.0)]
WGS84 = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137,298.257223563]]]'


def shp(polygons):
    out = b""
    for i, rings in enumerate(polygons):
        closed = [[*r, r[0]] for r in rings]
        points = [p for r in closed for p in r]
        starts = [sum(len(r) for r in closed[:k]) for k in range(len(closed))]
        body = struct.pack("<i4d", 5, 0, 0, 9, 9) + struct.pack("<ii", len(closed), len(points)) + struct.pack(f"<{len(closed)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        out += struct.pack(">ii", i + 1, len(body) // 2) + body
    return struct.pack(">i", 9994) + bytes(20) + struct.pack(">i", (100 + len(out)) // 2) + struct.pack("<ii", 1000, 5) + bytes(64) + out


def dbf(names, rows, size=20):
    head = 33 + 32 * len(names)
    fields = b"".join(n.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([size]) + bytes(15) for n in names)
    body = b"".join(b" " + b"".join(v.encode().ljust(size) for v in r) for r in rows)
    return b"\x03" + bytes(3) + struct.pack("<IHH", len(rows), head, 1 + size * len(names)) + bytes(20) + fields + b"\r" + body


def zipped(path, files):
    with zipfile.ZipFile(path, "w") as z:
        for name, content in files.items():
            z.writestr(name, content)
    return str(path)


ROWS = [("P1", "Square", "park"), ("P2", "역", "station")]


def shapefile(path, rows=ROWS, polygons=([OUTER, HOLE, SECOND], [SECOND]), **other):
    files = {"a.shp": shp(polygons), "a.shx": b"", "a.dbf": dbf(["AREA_CD", "AREA_NM", "CATEGORY"], rows), "a.prj": WGS84, "a.cpg": "UTF-8"}
    return zipped(path, files | {k.replace("_", "."): v for k, v in other.items()})


def xlsx(path, rows, sheet="List"):
    shared = sorted({v for r in rows for v in r if v})
    cell = lambda v, at: f'<c r="{at}" t="s"><v>{shared.index(v)}</v></c>' if v else ""
    text = "".join(f'<row r="{i}">' + "".join(cell(v, f"{chr(65 + j)}{i}") for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    return zipped(path, {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{sheet}" sheetId="1" r:id="rId7"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}">' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{text}</sheetData></worksheet>',
    })


HEAD = ["", "CATEGORY", "AREA_CD", "AREA_NM"]
NEEDED = ["AREA_CD", "AREA_NM", "CATEGORY"]


def test_master_of_both_files(spark, tmp_path):
    shapes = areas.read_areas(spark, shapefile(tmp_path / "a.zip"))
    names = areas.read_sheet(spark, xlsx(tmp_path / "a.xlsx", [HEAD, ["", "park", "P1", " Square "], [], ["", "station", "P2", "역"]]), "List", NEEDED)
    rows = {r.area_cd: r for r in areas.join_master(names, shapes).collect()}
    assert {r.area_cd: (r.name, r.category) for r in rows.values()} == {"P1": ("Square", "park"), "P2": ("역", "station")}
    assert [(r.hole, list(zip(r.lngs, r.lats))) for r in rows["P1"].rings] == [(False, OUTER), (True, HOLE), (False, SECOND)]
    for other, said in (([("P1", "Square", "park")], "no name: P2"), ([*ROWS, ("P3", "x", "y")], "no shape: P3"), ([("P1", "Round", "park"), ROWS[1]], "other names: P1"), ([*ROWS, ROWS[0]], "twice in names: P1")):
        with pytest.raises(ValueError, match=said):
            areas.join_master(spark.createDataFrame(other, "AREA_CD string, AREA_NM string, CATEGORY string"), shapes)


def test_files_that_are_not_as_they_should(spark, tmp_path):
    good = open(shapefile(tmp_path / "g.zip"), "rb").read()
    assert len(areas.read_shapes(good, NEEDED)) == 2
    bad = {
        "WGS84": {"a_prj": "GEOGCS[other]"},
        "UTF-8": {"a_cpg": "949"},
        "2 files end": {"b_dbf": b""},
        "1 records for 2": {"a_dbf": dbf(NEEDED, ROWS[:1])},
        "are missing: CATEGORY": {"a_dbf": dbf(NEEDED[:2], [r[:2] for r in ROWS])},
        "whole": {"a_shp": shp([[OUTER], [OUTER]])[:-8]},
        "polygon": {"a_shp": shp([[OUTER], [OUTER]]).replace(struct.pack("<i4d", 5, 0, 0, 9, 9), struct.pack("<i4d", 3, 0, 0, 9, 9))},
    }
    for i, (said, files) in enumerate(bad.items()):
        with pytest.raises(ValueError, match=said):
            areas.read_shapes(open(shapefile(tmp_path / f"{i}.zip", **files), "rb").read(), NEEDED)
    with pytest.raises(ValueError, match="no sheet"):
        areas.sheet_rows(open(xlsx(tmp_path / "b.xlsx", [HEAD]), "rb").read(), "Other")
    with pytest.raises(Exception, match="row 2 has an empty cell"):
        areas.read_sheet(spark, xlsx(tmp_path / "c.xlsx", [HEAD, ["", "park", "P1"]]), "List", NEEDED).collect()
    with pytest.raises(Exception, match="missing: AREA_NM"):
        areas.read_sheet(spark, xlsx(tmp_path / "d.xlsx", [HEAD[:3], ["", "park", "P1"]]), "List", NEEDED).collect()
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("x.txt", "")
    with pytest.raises(ValueError, match="0 files end"):
        areas.read_shapes(buffer.getvalue(), NEEDED)


def test_points_and_cells_of_areas_with_holes(spark, tmp_path):
    a = areas.read_areas(spark, shapefile(tmp_path / "a.zip")).withColumn("hotspot_id", F.substring("area_cd", 2, 1).cast("long"))
    at = {(0.5, 0.5): True, (2.0, 2.0): False, (1.0, 2.0): True, (4.0, 4.0): True, (5.0, 1.0): False, (7.0, 1.0): True, (7.0, 3.0): False, (2.0, 3.5): True}
    df = spark.createDataFrame([(x, y) for x, y in at], "lng double, lat double").crossJoin(a.where("hotspot_id = 1"))
    got = {(r.lng, r.lat): r.i for r in df.select("lng", "lat", inside_rings(F.col("lat"), F.col("lng"), F.col("rings")).alias("i")).collect()}
    assert got == at
    points = spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(at)], "cafe_id long, lat double, lng double")
    near = geometry.near_areas(points, a.where("hotspot_id = 1"), 120_000.0)
    d = {list(at)[r.cafe_id]: r.distance_m for r in near.collect()}
    assert {k for k, v in d.items() if v == 0} == {k for k, v in at.items() if v}
    assert d[2.0, 2.0] == pytest.approx(111_195, rel=0.01) and d[7.0, 3.0] == pytest.approx(111_195, rel=0.01) and d[5.0, 1.0] == pytest.approx(111_195, rel=0.01)
    cells = spark.createDataFrame([(c, [y, y, y + 2, y + 2], [x, x + 2, x + 2, x]) for c, (x, y) in enumerate([(0.0, 0.0), (1.0, 1.0), (3.0, 0.0), (7.0, 1.0), (20.0, 20.0)])], "cell_id long, c_lats array<double>, c_lngs array<double>")
    weights = {(r.hotspot_id, r.cell_id): r.weight for r in geometry.ring_weights(a.crossJoin(cells)).collect()}
    assert weights == {(1, 0): 0.75, (1, 2): 0.5, (1, 3): 0.25, (2, 3): 0.25}


def test_one_spot_and_one_shape_are_measured_once(spark):
    spots = [(37.5 + i * 0.004, 127.0 + i * 0.003) for i in range(12)]
    points = spark.createDataFrame([(100 * j + i, *p) for i, p in enumerate(spots) for j in range(3)], "cafe_id bigint, lat double, lng double")
    square = lambda y, x, d: ([y - d, y - d, y + d, y + d], [x - d, x + d, x + d, x - d])
    rows = [(10 * j + i, *square(37.5 + i * 0.012, 127.0 + i * 0.008, 0.002 + i % 2 * 0.001)) for i in range(4) for j in range(5)]
    areas = spark.createDataFrame(rows, "hotspot_id bigint, lats array<double>, lngs array<double>")
    shapes, members = geometry.by_shape(areas)
    assert shapes.count() == 4 and members.count() == 20
    every = geometry.near_areas(points, areas, 900.0)
    order = lambda df, cols: sorted(map(tuple, df.select(*cols).collect()))
    cols = ["cafe_id", "hotspot_id", "distance_m"]
    assert order(points.join(geometry.areas_at(points, areas, 900.0), ["lat", "lng"]), cols) == order(every, cols)
    chosen = geometry.chosen_at(points, areas, 900.0, 3)
    assert chosen.count() * 3 == points.join(chosen, ["lat", "lng"]).count()
    by_cafe: dict = {}
    for cafe, area, d in order(every, cols):
        by_cafe.setdefault(cafe, []).append((d, area))
    want = sorted((c, a, d) for c, near in by_cafe.items() for d, a in ([x for x in near if x[0] == 0] or sorted(near)[:3]))
    assert order(points.join(chosen, ["lat", "lng"]), cols) == want and any(d > 0 for *_, d in want)
