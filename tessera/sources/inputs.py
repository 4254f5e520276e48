"""Inputs with rules of their own: observations in the field, candidates, calendars, centroids, place extracts."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.timing import zoned_time
from tessera.sources.files import quarantine

# Columns of observation files, and what their text columns may say.
TRUTH_COLUMNS = ["cafe_id", "observed_at", "slot", "observed_area_level", "pedestrians_per_min", "flow_obstruction", "observer_notes", "observer_id", "observation_role"]
OBSTRUCTIONS = ["none", "repeated_avoidance", "blocked"]
ROLES = ["primary", "reliability"]


def area_level(per_min: Column, obstruction: Column, limits: tuple[float, float, float] = (5.0, 15.0, 30.0)) -> Column:
    """The level that a count of passers-by gives; what blocks the way raises it."""
    level = F.when(per_min <= limits[0], 1).when(per_min <= limits[1], 2).when(per_min <= limits[2], 3).otherwise(4)
    return F.when(obstruction == "blocked", 4).when(obstruction == "repeated_avoidance", F.greatest(level, F.lit(3))).otherwise(level)


def read_header(spark: SparkSession, path: str, needed: list[str]) -> DataFrame:
    """A CSV file as text columns; a needed column that is missing makes it unusable, others may be there."""
    df = spark.read.option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    df = df.withColumnsRenamed({c: c.removeprefix("\ufeff") for c in df.columns})
    if missing := sorted(set(needed) - set(df.columns)):
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def read_truths(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid observations with typed columns, and the other rows with the names of the rules that they break.

    The level has to be the one that the count and the obstruction give, and
    an obstruction needs a note. observed_venue_level may be missing or blank.
    """
    raw = read_header(spark, path, TRUTH_COLUMNS)
    if "observed_venue_level" not in raw.columns:
        raw = raw.withColumn("observed_venue_level", F.lit(None).cast("string"))
    t = lambda c: F.trim(F.col(c))
    number = lambda c, form, kind: F.when(t(c).rlike(form), F.expr(f"try_cast(trim({c}) AS {kind})"))
    df = raw.select(
        F.struct("*").alias("raw"),
        number("cafe_id", "^[0-9]+$", "bigint").alias("cafe_id"),
        zoned_time(t("observed_at")).alias("observed_at"),
        F.nullif(t("slot"), F.lit("")).alias("slot"),
        number("observed_area_level", "^[1-4]$", "int").alias("observed_area_level"),
        number("observed_venue_level", "^[1-4]$", "int").alias("observed_venue_level"),
        number("pedestrians_per_min", r"^[0-9]+(\.[0-9]+)?$", "double").alias("pedestrians_per_min"),
        t("flow_obstruction").alias("flow_obstruction"),
        F.coalesce(t("observer_notes"), F.lit("")).alias("observer_notes"),
        F.nullif(t("observer_id"), F.lit("")).alias("observer_id"),
        t("observation_role").alias("observation_role"),
    )
    venue = F.coalesce(F.trim(F.col("raw.observed_venue_level")), F.lit(""))
    good, bad = quarantine(
        df,
        {
            "cafe_id": F.col("cafe_id") > 0,
            "observed_at": F.col("observed_at").isNotNull(),
            "slot": F.col("slot").isNotNull(),
            "observed_area_level": F.col("observed_area_level").isNotNull(),
            "observed_venue_level": (venue == "") | F.col("observed_venue_level").isNotNull(),
            "pedestrians_per_min": F.col("pedestrians_per_min").isNotNull(),
            "flow_obstruction": F.col("flow_obstruction").isin(OBSTRUCTIONS),
            "observer_notes": (F.col("flow_obstruction") == "none") | (F.col("observer_notes") != ""),
            "observer_id": F.col("observer_id").isNotNull(),
            "observation_role": F.col("observation_role").isin(ROLES),
            "evidence": F.col("observed_area_level") == area_level(F.col("pedestrians_per_min"), F.col("flow_obstruction")),
        },
    )
    return good.drop("raw"), bad.select("raw.*", "errors")


def truth_faults(truths: DataFrame) -> DataFrame:
    """(cafe_id, slot, fault): an observer who stands twice in a place and slot, and slots without exactly one primary or with several reliability observations."""
    twice = truths.groupBy("cafe_id", "slot", "observer_id").count().where("count > 1").select("cafe_id", "slot", F.lit("observer_twice").alias("fault")).distinct()
    n = truths.groupBy("cafe_id", "slot").agg(F.count_if(F.col("observation_role") == "primary").alias("p"), F.count_if(F.col("observation_role") == "reliability").alias("r"))
    roles = n.select("cafe_id", "slot", F.explode(F.array_compact(F.array(F.when(F.col("p") != 1, "not_one_primary"), F.when(F.col("r") > 1, "several_reliability")))).alias("fault"))
    return twice.union(roles)


def read_candidates(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Reviewed candidates: of the columns given, those rows whose column reviewed says yes; another answer than yes, no or nothing is an error."""
    df = read_header(spark, path, [*columns, "reviewed"])
    said = F.lower(F.trim(F.coalesce("reviewed", F.lit(""))))
    known = F.when(said.isin("yes", "no", ""), said == "yes").otherwise(F.raise_error(F.concat(F.lit("not an answer: "), said)).cast("boolean"))
    return df.where(known).select(*columns)


def _json(spark: SparkSession, path: str) -> object:
    """A small JSON file, read through the engine, as it may be where only that can read."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def read_calendar(spark: SparkSession, path: str) -> list[date]:
    """The days of a calendar {"from", "to", "holidays": [{"date", "name"}]}, in order; days outside or named twice are errors."""
    found = _json(spark, path)
    first, last = date.fromisoformat(found["from"]), date.fromisoformat(found["to"])
    days = [date.fromisoformat(h["date"]) for h in found["holidays"]]
    if days != sorted(set(days)) or any(not first <= d <= last for d in days) or any(not h["name"].strip() for h in found["holidays"]):
        raise ValueError("the calendar's days aren't in order, once each and inside its bounds")
    return days


def read_centroids(spark: SparkSession, path: str, crs: str = "EPSG:4326") -> DataFrame:
    """(zone_id, lat, lng) out of {"schema": 1, "crs", "centroids": {code: [lng, lat]}}; anything else is an error."""
    found = _json(spark, path)
    if found.get("schema") != 1 or found.get("crs") != crs:
        raise ValueError(f"schema 1 in {crs} is needed")
    rows = []
    for code, place in sorted(found["centroids"].items()):
        lng, lat = place
        if not (code.isascii() and code.isdecimal()) or not (-180 <= lng <= 180 and -90 <= lat <= 90):
            raise ValueError(f"{code}: {place} is no centroid")
        rows.append((code, float(lat), float(lng)))
    return spark.createDataFrame(rows, "zone_id string, lat double, lng double")


def read_places(spark: SparkSession, path: str, box: tuple[float, float, float, float], category: str, confidence: float | None = None) -> DataFrame:
    """Places of a category inside a box out of Parquet with nested columns, narrowed by the scan.

    The scan reads only the fields that are used, and skips what the bounds,
    the category and the confidence exclude. Rows: id, name, road_address,
    phone, category, confidence, lat, lng.
    """
    west, south, east, north = box
    df = spark.read.parquet(path)
    inside = (F.col("bbox.xmin") >= west) & (F.col("bbox.xmax") <= east) & (F.col("bbox.ymin") >= south) & (F.col("bbox.ymax") <= north)
    found = df.where(inside & (F.col("categories.primary") == category))
    if confidence is not None:
        found = found.where(F.col("confidence") >= confidence)
    first = lambda c: F.try_element_at(F.col(c), F.lit(1))
    return found.select(
        "id",
        F.col("names.primary").alias("name"),
        first("addresses")["freeform"].alias("road_address"),
        first("phones").alias("phone"),
        F.col("categories.primary").alias("category"),
        "confidence",
        ((F.col("bbox.ymin") + F.col("bbox.ymax")) / 2).alias("lat"),
        ((F.col("bbox.xmin") + F.col("bbox.xmax")) / 2).alias("lng"),
    )
