"""The master of areas: names from a sheet of an XLSX file, shapes from a zipped shapefile, joined by equal sets of codes."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RING = "struct<hole:boolean,lngs:array<double>,lats:array<double>>"
POLYGON = 5


def signed_area(ring: Sequence[tuple[float, float]]) -> float:
    """Above 0 counter-clockwise; the first point isn't repeated."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]])) / 2


def shapes(content: bytes) -> Iterator[list[list[tuple[float, float]]]]:
    """The rings of each polygon of a .shp file, as they run there: outer ones clockwise, holes against it."""
    if len(content) < 100 or struct.unpack(">i", content[:4])[0] != 9994 or 2 * struct.unpack(">i", content[24:28])[0] != len(content):
        raise ValueError("not a whole shapefile")
    at = 100
    while at < len(content):
        size = 2 * struct.unpack(">i", content[at + 4 : at + 8])[0]
        body = content[at + 8 : at + 8 + size]
        at += 8 + size
        if len(body) != size or struct.unpack("<i", body[:4])[0] != POLYGON:
            raise ValueError("a shape isn't a polygon")
        n_parts, n_points = struct.unpack("<ii", body[36:44])
        starts = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n_points]
        flat = struct.unpack(f"<{2 * n_points}d", body[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n_points])
        points = list(zip(flat[::2], flat[1::2]))
        rings = [points[a:b] for a, b in zip(starts, starts[1:])]
        if not rings or any(len(r) < 4 or r[0] != r[-1] for r in rings):
            raise ValueError("a ring isn't closed")
        yield [r[:-1] for r in rings]


def attributes(content: bytes, encoding: str = "utf-8") -> Iterator[dict[str, str]]:
    """The records of a .dbf file as trimmed text; one that is marked as deleted is an error."""
    n, head, width = struct.unpack("<IHH", content[4:12])
    fields, at = [], 32
    while content[at] != 0x0D:
        fields.append((content[at : at + 11].split(b"\0")[0].decode("ascii"), content[at + 16]))
        at += 32
    for i in range(n):
        row = content[head + i * width : head + (i + 1) * width]
        if len(row) != width or row[:1] != b" ":
            raise ValueError(f"record {i} is cut short or deleted")
        out, at = {}, 1
        for name, size in fields:
            out[name] = row[at : at + size].decode(encoding).strip()
            at += size
        yield out


def one_member(z: zipfile.ZipFile, suffix: str) -> bytes:
    names = [n for n in z.namelist() if n.lower().endswith(suffix)]
    if len(names) != 1:
        raise ValueError(f"{len(names)} files end in {suffix}")
    return z.read(names[0])


def read_shapes(content: bytes, wanted: Sequence[str]) -> list[tuple]:
    """(the attributes wanted, rings) of a zipped shapefile in longitude and latitude on WGS84."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        projection = one_member(z, ".prj").decode("utf-8-sig").upper().replace(" ", "")
        if not ("GCS_WGS_1984" in projection and "D_WGS_1984" in projection):
            raise ValueError("the shapes aren't in WGS84 degrees")
        if one_member(z, ".cpg").decode("ascii").strip().upper().replace("-", "") != "UTF8":
            raise ValueError("the attributes aren't in UTF-8")
        rows, rings = list(attributes(one_member(z, ".dbf"))), list(shapes(one_member(z, ".shp")))
    if len(rows) != len(rings):
        raise ValueError(f"{len(rows)} records for {len(rings)} shapes")
    if rows and (missing := [c for c in wanted if c not in rows[0]]):
        raise ValueError(f"attributes are missing: {', '.join(missing)}")
    return [(*(r[c] for c in wanted), s) for r, s in zip(rows, rings)]


def read_areas(spark: SparkSession, path: str, wanted: Sequence[str] = ("AREA_CD", "AREA_NM", "CATEGORY")) -> DataFrame:
    """(area_cd, name, category, rings) of zipped shapefiles; rings are (hole, lngs, lats), the first point not repeated.

    A file is read by one task, as it can't be split. An empty attribute is an error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f.content:
                rows = []
                for *values, rings in read_shapes(content, wanted):
                    if not all(values):
                        raise ValueError("an attribute is empty")
                    rows.append((*values, [{"hole": signed_area(r) > 0, "lngs": [p[0] for p in r], "lats": [p[1] for p in r]} for r in rings]))
                yield pd.DataFrame(rows, columns=["area_cd", "name", "category", "rings"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, f"area_cd string, name string, category string, rings array<{RING}>")


SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_rows(content: bytes, sheet: str) -> list[list[str | None]]:
    """The cells of a sheet of an XLSX file as text, a row each; numbers as they are written there."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parse = lambda name: ElementTree.fromstring(z.read(name))
        names = {s.get("name"): s.get(LINK) for s in parse("xl/workbook.xml").iter(f"{SHEET}sheet")}
        if sheet not in names:
            raise ValueError(f"there is no sheet {sheet!r}")
        targets = {r.get("Id"): r.get("Target") for r in parse("xl/_rels/workbook.xml.rels")}
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{SHEET}t")) for s in parse("xl/sharedStrings.xml").iter(f"{SHEET}si")]
        target = targets[names[sheet]].removeprefix("/").removeprefix("xl/")
        rows = []
        for row in parse(f"xl/{target}").iter(f"{SHEET}row"):
            cells: list[str | None] = []
            for c in row.iter(f"{SHEET}c"):
                letters = "".join(x for x in c.get("r", "") if x.isalpha())
                at = len(cells)
                if letters:
                    at = 0
                    for x in letters:
                        at = 26 * at + ord(x) - 64
                    at -= 1
                cells += [None] * (at - len(cells))
                value = c.find(f"{SHEET}v")
                if c.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{SHEET}t"))
                elif value is None:
                    text = None
                else:
                    text = shared[int(value.text)] if c.get("t") == "s" else value.text
                cells.append(text)
            rows.append(cells)
        return rows


def read_sheet(spark: SparkSession, path: str, sheet: str, needed: Sequence[str]) -> DataFrame:
    """The needed columns of a sheet, trimmed, by the names in its first row; wholly empty rows go, and an empty cell is an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f.content:
                head, *rows = sheet_rows(content, sheet) or [[]]
                at = {c.strip(): i for i, c in enumerate(head) if c and c.strip()}
                if missing := sorted(set(needed) - set(at)):
                    raise ValueError(f"columns are missing: {', '.join(missing)}")
                made = []
                for n, r in enumerate(rows, 2):
                    if any(v is not None for v in r):
                        values = [(r[at[c]] if at[c] < len(r) else None) for c in needed]
                        if not all(v and v.strip() for v in values):
                            raise ValueError(f"row {n} has an empty cell")
                        made.append([v.strip() for v in values])
                yield pd.DataFrame(made, columns=list(needed))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"`{c}` string" for c in needed))


def join_master(names: DataFrame, areas: DataFrame) -> DataFrame:
    """areas whose codes, names and categories are those of names (AREA_CD, AREA_NM, CATEGORY); any difference is an error.

    Codes that one side alone has are told for both sides. A master has some
    hundreds of rows.
    """
    a = names.select(F.col("AREA_CD").alias("area_cd"), F.col("AREA_NM").alias("_name"), F.col("CATEGORY").alias("_category"))
    for side, df in (("names", a), ("areas", areas)):
        if twice := [r[0] for r in df.groupBy("area_cd").count().where("count > 1").orderBy("area_cd").limit(10).collect()]:
            raise ValueError(f"codes stand twice in {side}: {', '.join(twice)}")
    both = a.withColumn("_a", F.lit(True)).join(areas.select("area_cd", "name", "category").withColumn("_b", F.lit(True)), "area_cd", "full")
    wrong = both.where("_a IS NULL OR _b IS NULL OR _name <> name OR _category <> category").orderBy("area_cd").collect()
    if wrong:
        of = lambda ok: ", ".join(r.area_cd for r in wrong if ok(r)) or "none"
        raise ValueError(f"no shape: {of(lambda r: not r._b)}; no name: {of(lambda r: not r._a)}; other names: {of(lambda r: r._a and r._b)}")
    return areas
