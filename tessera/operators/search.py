"""Reads over the catalogue: search, boxes, pages and the order of results."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geo import haversine_m
from tessera.params import Search


def normal_term(text: str | None) -> str | None:
    """White space collapsed and lower case; None if nothing is left."""
    return " ".join((text or "").split()).lower() or None


def brand_terms(brand: str, aliases: Mapping[str, Sequence[str]]) -> list[str]:
    """The names to look for: the one asked for, then the brand's other aliases. An unknown brand is an error."""
    wanted = normal_term(brand)
    for name, others in aliases.items():
        terms = [t for a in others if (t := normal_term(a))]
        if wanted in {normal_term(name), *terms}:
            return [wanted, *(t for t in terms if t != wanted)]
    raise ValueError(f"unsupported brand {brand!r}")


def relevance(name: Column, term: str) -> Column:
    """0 for the name itself, 1 for its beginning, 2 for a part of it, else 3."""
    low = F.lower(name)
    return F.when(low == term, 0).when(low.startswith(term), 1).when(low.contains(term), 2).otherwise(3)


def squared_degrees(lat: Column, lng: Column, origin: tuple[float, float], p: Search = Search()) -> Column:
    """A measure for ordering inside the region: squared degrees, longitudes shrunk as in its middle latitude."""
    _, south, _, north = p.box
    dx = (lng - origin[1]) * math.cos(math.radians((south + north) / 2))
    return (lat - origin[0]) * (lat - origin[0]) + dx * dx


def search(cafes: DataFrame, q: str | None = None, brand: str | None = None, aliases: Mapping[str, Sequence[str]] | None = None, origin: tuple[float, float] | None = None, limit: int | None = None, address: str | None = None, p: Search = Search()) -> DataFrame:
    """Active cafes of the region whose name, or column address, holds the term and whose name holds an alias of the brand.

    Signs in a term mean themselves. With an origin the nearest come first,
    otherwise the most relevant, then by name; the id settles the rest. At
    most limit rows, in that order. No term, one that is too short or too
    long, and a limit out of bounds are errors.
    """
    term, terms = normal_term(q), brand_terms(brand, aliases or {}) if normal_term(brand) else None
    if term is None and terms is None:
        raise ValueError("a term or a brand is needed")
    if term is not None and not p.shortest <= len(term) <= p.longest:
        raise ValueError(f"a term has {p.shortest} to {p.longest} characters")
    limit = p.limit if limit is None else limit
    if not 1 <= limit <= p.most:
        raise ValueError(f"the limit is 1 to {p.most}")
    if origin is not None and not (-90 <= origin[0] <= 90 and -180 <= origin[1] <= 180):
        raise ValueError("the origin isn't on the globe")
    west, south, east, north = p.box
    name = F.lower("name")
    found = cafes.where(F.col("active") & F.col("lng").between(west, east) & F.col("lat").between(south, north))
    if term is not None:
        holds = name.contains(term)
        found = found.where(holds | F.coalesce(F.lower(address).contains(term), F.lit(False)) if address else holds)
    if terms is not None:
        any_of = F.lit(False)
        for t in terms:
            any_of = any_of | name.contains(t)
        found = found.where(any_of)
    found = found.withColumn("relevance", relevance(F.col("name"), term or terms[0]))
    if origin is not None:
        return found.orderBy(squared_degrees(F.col("lat"), F.col("lng"), origin, p), "cafe_id").limit(limit)
    return found.orderBy("relevance", name, "cafe_id").limit(limit)


def parse_bbox(text: str, span: float = 0.5) -> tuple[float, float, float, float]:
    """west, south, east and north out of four numbers with commas, in order and no wider than span degrees each way."""
    try:
        west, south, east, north = (float(x) for x in text.split(","))
    except ValueError:
        raise ValueError("a box is four numbers") from None
    if not all(map(math.isfinite, (west, south, east, north))):
        raise ValueError("a box is of finite numbers")
    if not (-180 <= west < east <= 180 and -90 <= south < north <= 90):
        raise ValueError("a box goes from its south-west to its north-east corner")
    if east - west > span or north - south > span:
        raise ValueError(f"a box spans {span} degrees at most")
    return west, south, east, north


def in_box(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    west, south, east, north = box
    return df.where(F.col("lng").between(west, east) & F.col("lat").between(south, north))


def all_in_box(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """df, or an error when it is read if any row lies outside the box or nowhere."""
    west, south, east, north = box
    inside = F.coalesce(F.col("lng").between(west, east) & F.col("lat").between(south, north), F.lit(False))
    return df.where(F.when(inside, F.lit(True)).otherwise(F.raise_error(F.lit("a row lies outside the box")).cast("boolean")))


def page(df: DataFrame, key: str, after: int | None, limit: int) -> DataFrame:
    """The next rows by key."""
    return (df if after is None else df.where(F.col(key) > after)).orderBy(key).limit(limit)


def by_distance(df: DataFrame, origin: tuple[float, float], key: str, radius_m: float = 6_371_000.0) -> DataFrame:
    """df with distance_m on a sphere of radius_m, the nearest first."""
    lat, lng = F.lit(origin[0]), F.lit(origin[1])
    return df.withColumn("distance_m", haversine_m(lat, lng, F.col("lat"), F.col("lng"), radius_m)).orderBy("distance_m", key)


def brand_name_matches(name: Column, aliases: Sequence[str]) -> Column:
    """Whether a name without its spaces holds an alias without its own."""
    low = F.regexp_replace(F.lower(name), r"\s", "")
    out = F.lit(False)
    for a in aliases:
        if plain := "".join(a.split()).lower():
            out = out | low.contains(plain)
    return out


def merge_tiles(tiles: Sequence[DataFrame], key: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows of overlapping tiles that lie in the box, once each; of rows with one key that of the first tile stays, and of several there the least."""
    out = None
    for i, t in enumerate(tiles):
        numbered = in_box(t, box).withColumn("_tile", F.lit(i))
        out = numbered if out is None else out.unionByName(numbered)
    names = [c for c in tiles[0].columns if c != key]
    row = F.struct("_tile", *names)
    return out.groupBy(key).agg(F.min(row).alias("_row")).select(*[F.col(key) if c == key else F.col(f"_row.{c}") for c in tiles[0].columns])


def health(hotspots: DataFrame, snapshots: DataFrame, cafes: DataFrame, cycles: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """One row of counts and latest times over four tables, each read once."""
    since = now - F.expr(f"INTERVAL {hours} HOUR")
    parts = [
        hotspots.agg(F.count(F.lit(1)).alias("hotspots"), F.count_if("is_polled").alias("polled")),
        snapshots.agg(F.count(F.lit(1)).alias("snapshots"), F.max("observed_at").alias("newest"), F.count_distinct(F.when(F.col("observed_at") > since, F.col("hotspot_id"))).alias("seen")),
        cafes.agg(F.count_if("active").alias("active_cafes")),
        cycles.agg(F.max("started_at").alias("last_cycle"), F.sum("failed").alias("failed")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.crossJoin(more)  # a row each
    return out
