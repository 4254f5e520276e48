"""Files in and out: strict CSV and JSON, catalogues with manifests, atomic publishing."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Labels of levels in the feed, and the header of origin-destination files.
LEVELS = {"여유": 1, "보통": 2, "약간 붐빔": 3, "붐빔": 4}
OD_HEADER = ["o_admdong_cd", "d_admdong_cd", "st_time_cd", "fns_time_cd", "in_forn_div_nm", "forn_citiz_nm", "move_purpose", "move_dist", "move_time", "cnt", "etl_ymd"]
AREA = "struct<SeoulRtd:string, AREA_CD:string, AREA_NM:string, AREA_CONGEST_LVL:string, AREA_PPLTN_MIN:string, AREA_PPLTN_MAX:string, PPLTN_TIME:string, FCST_PPLTN:array<struct<FCST_TIME:string,FCST_CONGEST_LVL:string,FCST_PPLTN_MIN:string,FCST_PPLTN_MAX:string>>>"


def read_csv(spark: SparkSession, path: str, header: list[str], encoding: str = "UTF-8", extra: bool = False) -> DataFrame:
    """All columns as text, after the files' header lines were found to be header; extra allows more columns after it.

    Korean code pages need spark.sql.legacy.javaCharsets, which is set for
    the session if encoding isn't one of Spark's own.
    """
    if encoding.upper() not in ("UTF-8", "ISO-8859-1", "US-ASCII", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    found = spark.read.option("encoding", encoding).option("header", True).option("enforceSchema", False).csv(path)
    if found.columns[: len(header)] != header or (not extra and len(found.columns) != len(header)):
        raise ValueError(f"columns are {found.columns}, not {header}")
    df = spark.read.option("encoding", encoding).option("header", True).option("mode", "FAILFAST").schema(", ".join(f"`{c}` string" for c in found.columns)).csv(path)
    return df.select(*header)


def exact_decimal(text: Column, scale: int = 5, digits: int = 38) -> Column:
    """Text as a decimal, null if it has more than scale places: a cast would round."""
    return F.when(text.rlike(rf"^-?[0-9]{{1,{digits - scale}}}(\.[0-9]{{1,{scale}}})?$"), text.cast(f"decimal({digits},{scale})"))


def masked_value(text: Column) -> tuple[Column, Column]:
    """A value that may be masked by an asterisk: the decimal, and whether it was masked."""
    masked = F.trim(text) == "*"
    return F.when(~masked, exact_decimal(F.trim(text))), masked


def read_exact_parquet(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Parquet whose columns are those of schema, none more or less, in any order."""
    df = spark.read.parquet(path)
    want, have = ({f.name: f.dataType for f in s.fields} for s in (schema, df.schema))
    if want != have:
        raise ValueError(f"columns are {have}, not {want}")
    return df.select(*schema.names)


def parse_area(raw: Column) -> Column:
    """An area's reading out of its JSON: code, level, bounds and time in UTC; null fields where it says nonsense."""
    j = F.from_json(raw, AREA)
    level = F.coalesce(*[F.when(j.AREA_CONGEST_LVL == label, F.lit(n)) for label, n in LEVELS.items()])
    count = lambda c: F.when(c.rlike("^[0-9]{1,9}$"), c.cast("int"))
    at = F.to_utc_timestamp(F.try_to_timestamp(j.PPLTN_TIME, F.lit("yyyy-MM-dd HH:mm")), "Asia/Seoul")
    return F.struct(j.AREA_CD.alias("area_cd"), level.alias("level"), count(j.AREA_PPLTN_MIN).alias("ppltn_min"), count(j.AREA_PPLTN_MAX).alias("ppltn_max"), at.alias("observed_at"), j.FCST_PPLTN.alias("forecast"))


def find_record(raw: Column, needed: tuple[str, ...] = ("AREA_CD", "PPLTN_TIME")) -> Column:
    """The first object of a JSON text that has all fields needed, however deep it lies, as JSON text; null without one.

    Objects are searched before what they hold, lists and fields in order.
    """

    @F.pandas_udf("string")
    def search(texts: pd.Series) -> pd.Series:
        def found(value: object) -> dict | None:
            queue = [value]
            while queue:
                v = queue.pop()
                if isinstance(v, dict):
                    if all(k in v for k in needed):
                        return v
                    queue += reversed(list(v.values()))
                elif isinstance(v, list):
                    queue += reversed(v)
            return None

        def one(text: str | None) -> str | None:
            try:
                hit = found(json.loads(text)) if text else None
            except ValueError:
                return None
            return None if hit is None else json.dumps(hit, ensure_ascii=False)

        return texts.map(one)

    return search(raw)


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that break no rule, and the others with errors, the names of all that they break."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    marked = df.withColumn("errors", broken)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def read_zip_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Lines (file, line_no, line) of ZIP files that hold one CSV each; a file is read by one task, as it can't be split."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for f in frames:
            for name, content in zip(f.path, f.content):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if len(z.namelist()) != 1:
                        raise ValueError(f"{name} holds {len(z.namelist())} files")
                    with z.open(z.namelist()[0]) as member:
                        rows = []
                        for i, line in enumerate(io.TextIOWrapper(member, encoding)):
                            rows.append((name, i, line.rstrip("\r\n")))
                            if len(rows) == 10_000:
                                yield pd.DataFrame(rows, columns=["file", "line_no", "line"])
                                rows = []
                        yield pd.DataFrame(rows, columns=["file", "line_no", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, line_no bigint, line string")


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def publish(df: DataFrame, path: str, writer: str = "parquet", **options: str) -> None:
    """Writes beside path and then renames, so that readers see all or nothing; an existing path is refused."""
    spark = df.sparkSession
    fs, at = _fs(spark, path)
    if fs.exists(at):
        raise FileExistsError(path)
    part = f"{path.rstrip('/')}.part"
    _, part_at = _fs(spark, part)
    fs.delete(part_at, True)
    df.write.format(writer).options(**(({"compression": "zstd"} if writer == "parquet" else {}) | options)).save(part)
    if not fs.rename(part_at, at):
        raise OSError(f"{part} can't be renamed")


def digest(df: DataFrame, key: str) -> tuple[int, str]:
    """The number of rows and a digest of their JSON that doesn't depend on their order."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))).cast("binary"), 256)
    parts = [F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    r = df.agg(F.count(F.lit(1)), *[F.sum(p) for p in parts], F.count_distinct(key)).first()
    if r[0] != r[5]:
        raise ValueError(f"{key} isn't unique")
    return r[0], hashlib.sha256("|".join(map(str, r[:5])).encode()).hexdigest()


def write_catalogue(df: DataFrame, path: str, key: str) -> dict:
    """JSON lines in the order of key, and after them a manifest with count and digest."""
    n, code = digest(df, key)
    publish(df.orderBy(key), f"{path}/rows", "json")
    manifest = {"count": n, "digest": code, "key": key}
    fs, at = _fs(df.sparkSession, f"{path}/manifest.json")
    out = fs.create(at, False)
    out.write(bytearray(json.dumps(manifest, sort_keys=True, separators=(",", ":")).encode()))
    out.close()
    return manifest


def read_catalogue(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A catalogue whose rows are those of its manifest; anything else is an error."""
    manifest = json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0])
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/rows")
    if digest(df, manifest["key"]) != (manifest["count"], manifest["digest"]):
        raise ValueError("the rows aren't those of the manifest")
    return df


def geojson(df: DataFrame, lat: str, lng: str, properties: list[str]) -> DataFrame:
    """One feature of type Point in each row, as JSON text."""
    point = F.struct(F.lit("Point").alias("type"), F.array(lng, lat).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))
