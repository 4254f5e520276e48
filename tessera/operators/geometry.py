"""Polygons: which points they cover, how far their edges are, how they overlap cells."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geo import M_PER_DEGREE, haversine_m, inside, inside_rings


def boundary_m(lat: Column, lng: Column, lats: Column, lngs: Column) -> Column:
    """Distance to the nearest point of a ring's edges, found by local scaling and measured on the sphere."""
    n = F.size(lats)
    kx = M_PER_DEGREE * F.cos(F.radians(lat))

    def edge(i: Column) -> Column:
        j = (i + 1) % n
        ax, ay = (F.get(lngs, i) - lng) * kx, (F.get(lats, i) - lat) * M_PER_DEGREE
        bx, by = (F.get(lngs, j) - lng) * kx, (F.get(lats, j) - lat) * M_PER_DEGREE
        dx, dy = bx - ax, by - ay
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(-(ax * dx + ay * dy), dx * dx + dy * dy), F.lit(0.0))))
        return haversine_m(lat, lng, lat + (ay + t * dy) / M_PER_DEGREE, lng + (ax + t * dx) / kx)

    return F.array_min(F.transform(F.sequence(F.lit(0), n - 1), edge))


def near_areas(points: DataFrame, areas: DataFrame, radius_m: float, max_lat: float = 60.0, cell_m: float = 1000.0) -> DataFrame:
    """Pairs of points (lat, lng) and areas (lats, lngs) with distance_m, 0 inside.

    areas may have rings instead of lats and lngs: several parts and holes, as
    (hole, lngs, lats). An area stands in every cell that its box widened by
    the radius touches, a point in its own, so they meet by equal cells. Cells
    are cell_m wide at least, which bounds the copies of an area. Only points
    in the widened box are measured against the edges.
    """
    dy = max(radius_m, cell_m) / M_PER_DEGREE * 1.01
    dx = dy / math.cos(math.radians(max_lat))
    cells = lambda low, high, d: F.sequence(F.floor((low - d) / d), F.floor((high + d) / d))
    lat, lng = F.col("lat"), F.col("lng")
    if "rings" in areas.columns:
        every = lambda c: F.flatten(F.transform("rings", lambda r: r[c]))
        ends = {c: (F.array_min(every(c)), F.array_max(every(c))) for c in ("lats", "lngs")}
        edge = F.array_min(F.transform("rings", lambda r: boundary_m(lat, lng, r.lats, r.lngs)))
        d = F.when(inside_rings(lat, lng, F.col("rings")), 0.0).otherwise(edge)
    else:
        ends = {c: (F.array_min(c), F.array_max(c)) for c in ("lats", "lngs")}
        ring = F.col("lats"), F.col("lngs")
        d = F.when(inside(lat, lng, *ring), 0.0).otherwise(boundary_m(lat, lng, *ring))
    boxed = areas.select("*", *[f(*ends[c]).alias(f"_{n}_{c}") for c in ends for n, f in (("low", lambda a, b: a), ("high", lambda a, b: b))])
    spread = boxed.withColumn("_cy", F.explode(cells(F.col("_low_lats"), F.col("_high_lats"), dy))).withColumn("_cx", F.explode(cells(F.col("_low_lngs"), F.col("_high_lngs"), dx)))
    placed = points.withColumn("_cy", F.floor(lat / dy)).withColumn("_cx", F.floor(lng / dx))
    up = (radius_m + 1.0) / M_PER_DEGREE * 1.01
    across = up / math.cos(math.radians(max_lat))
    boxes = lat.between(F.col("_low_lats") - up, F.col("_high_lats") + up) & lng.between(F.col("_low_lngs") - across, F.col("_high_lngs") + across)
    met = placed.join(spread, ["_cy", "_cx"]).where(boxes).drop("_cy", "_cx", *(c for c in boxed.columns if c not in areas.columns))
    return met.withColumn("distance_m", d).where(F.col("distance_m") <= radius_m)


def by_shape(areas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The shapes of areas (hotspot_id, and lats and lngs or rings), each once under its least hotspot_id as shape_id, and the areas (shape_id, hotspot_id) of each."""
    outline = [c for c in ("lats", "lngs", "rings") if c in areas.columns]
    shapes = areas.groupBy(*outline).agg(F.min("hotspot_id").alias("shape_id"))
    return shapes, areas.join(shapes, outline).select("shape_id", "hotspot_id")


def select_areas(pairs: DataFrame, k: int, point: Sequence[str] = ("cafe_id",), area: str = "hotspot_id") -> DataFrame:
    """All areas that cover a point or, where none does, the k nearest; adds rank, 1 for all that cover, and covers."""
    w = Window.partitionBy(*point)
    ranked = pairs.withColumns({"covers": F.min("distance_m").over(w) == 0, "rank": F.row_number().over(w.orderBy("distance_m", area))})
    chosen = ranked.where(F.when(F.col("covers"), F.col("distance_m") == 0).otherwise(F.col("rank") <= k))
    return chosen.withColumn("rank", F.when(F.col("covers"), 1).otherwise(F.col("rank")))


def areas_at(points: DataFrame, areas: DataFrame, radius_m: float) -> DataFrame:
    """Each spot (lat, lng) of points with the areas (hotspot_id) within radius_m and distance_m.

    Points at one spot and areas of one shape are measured once.
    """
    shapes, members = by_shape(areas)
    pairs = near_areas(points.select("lat", "lng").distinct(), shapes, radius_m).select("lat", "lng", "shape_id", "distance_m")
    return pairs.join(members, "shape_id").drop("shape_id")


def chosen_at(points: DataFrame, areas: DataFrame, radius_m: float, k: int) -> DataFrame:
    """Each spot (lat, lng) of points with all areas that cover it or, where none does, the k nearest within radius_m: hotspot_id, distance_m, rank and covers.

    The k nearest areas lie among the first k of the k nearest shapes: a shape
    comes in by its least hotspot_id, and equal distances go by that.
    """
    shapes, members = by_shape(areas)
    pairs = near_areas(points.select("lat", "lng").distinct(), shapes, radius_m).select("lat", "lng", "shape_id", "distance_m")
    at = select_areas(pairs, k, ("lat", "lng"), "shape_id").select("lat", "lng", "shape_id", "distance_m", "covers")
    numbered = members.withColumn("_n", F.row_number().over(Window.partitionBy("shape_id").orderBy("hotspot_id")))
    met = at.join(numbered, "shape_id").where(F.col("covers") | (F.col("_n") <= k)).drop("_n", "shape_id", "covers")
    return select_areas(met, k, ("lat", "lng"))


def clip(subject: list[tuple[float, float]], window: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The part of a ring inside a convex one that runs counter-clockwise."""
    out = subject
    for (ax, ay), (bx, by) in zip(window, window[1:] + window[:1]):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
        ring, out = out, []
        for p, q in zip(ring, ring[1:] + ring[:1]):
            s, t = side(p), side(q)
            if s >= 0:
                out.append(p)
            if s * t < 0:
                out.append((p[0] + (q[0] - p[0]) * s / (s - t), p[1] + (q[1] - p[1]) * s / (s - t)))
    return out


def area(ring: list[tuple[float, float]]) -> float:
    return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2


def cell_weights(pairs: DataFrame) -> DataFrame:
    """Rows (hotspot_id, cell_id, weight) for pairs of an area's ring and a convex cell's (c_lats, c_lngs); touching ones go.

    weight is the share of the cell that the area covers.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples():
                cell = list(zip(r.c_lngs, r.c_lats))
                share = area(clip(list(zip(r.lngs, r.lats)), cell)) / area(cell)
                if share > 0:
                    rows.append((r.hotspot_id, r.cell_id, min(1.0, share)))
            yield pd.DataFrame(rows, columns=["hotspot_id", "cell_id", "weight"])

    return pairs.select("hotspot_id", "cell_id", "lats", "lngs", "c_lats", "c_lngs").mapInPandas(run, "hotspot_id bigint, cell_id bigint, weight double")


def ring_weights(pairs: DataFrame) -> DataFrame:
    """As cell_weights, for areas of several parts and holes: rows (hotspot_id, cell_id, weight) for pairs of rings and a convex cell.

    Each ring is clipped by itself; holes take away what parts give, so parts
    must not overlap, nor holes reach beyond their part.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples():
                cell = list(zip(r.c_lngs, r.c_lats))
                covered = sum((-1 if ring["hole"] else 1) * area(clip(list(zip(ring["lngs"], ring["lats"])), cell)) for ring in r.rings)
                share = covered / area(cell)
                if share > 0:
                    rows.append((r.hotspot_id, r.cell_id, min(1.0, share)))
            yield pd.DataFrame(rows, columns=["hotspot_id", "cell_id", "weight"])

    return pairs.select("hotspot_id", "cell_id", "rings", "c_lats", "c_lngs").mapInPandas(run, "hotspot_id bigint, cell_id bigint, weight double")
