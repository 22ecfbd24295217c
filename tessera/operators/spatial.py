"""Spatial predicates over points, boxes and polygons, as built-in expressions.

A geometry is a point (lon, lat) in two columns; query shapes are Python boxes (west, south, east, north) and rings of
(lon, lat). Distances are great-circle metres on a sphere.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expressions import EARTH_M, haversine

Box = tuple[float, float, float, float]
Ring = Sequence[tuple[float, float]]


def in_box(lon: Column, lat: Column, box: Box) -> Column:
    """Inside or on the edge; a box whose west is greater than its east crosses the antimeridian."""
    west, south, east, north = box
    across = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return across & lat.between(south, north)


def in_ring(lon: Column, lat: Column, ring: Ring) -> Column:
    """Whether a point is inside a polygon without holes (even-odd rule), after a check of its box."""
    pts = list(ring)
    if pts[0] == pts[-1]:
        pts = pts[:-1]
    crossings = []
    for (x1, y1), (x2, y2) in zip(pts, [*pts[1:], pts[0]], strict=True):
        if y1 == y2:
            continue
        low, high = min(y1, y2), max(y1, y2)
        crossings.append(F.when((lat >= low) & (lat < high) & (lon < (lat - y1) * ((x2 - x1) / (y2 - y1)) + x1), 1).otherwise(0))
    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
    return in_box(lon, lat, (min(xs), min(ys), max(xs), max(ys))) & (F.pmod(reduce(lambda a, b: a + b, crossings), F.lit(2)) == 1)


def grown_box(lon: float, lat: float, metres: float) -> Box:
    """The box around a point that holds everything within `metres`."""
    dlat = math.degrees(metres / EARTH_M)
    if abs(lat) + dlat >= 90:
        return (-180.0, max(-90.0, lat - dlat), 180.0, min(90.0, lat + dlat))
    dlon = math.degrees(math.asin(min(1.0, math.sin(metres / EARTH_M) / math.cos(math.radians(lat)))))
    west, east = lon - dlon, lon + dlon
    return (west + 360 if west < -180 else west, lat - dlat, east - 360 if east > 180 else east, lat + dlat)


def within_distance(df: DataFrame, point: tuple[float, float], metres: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points within `metres`; the box is tested (and pushed down) first."""
    d = haversine(F.col(lon), F.col(lat), F.lit(point[0]), F.lit(point[1]))
    return df.where(in_box(F.col(lon), F.col(lat), grown_box(*point, metres))).withColumn("distance", d).where(F.col("distance") <= metres)


def contained(df: DataFrame, ring: Ring, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return df.where(in_ring(F.col(lon), F.col(lat), ring))


def boxed(df: DataFrame, box: Box, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return df.where(in_box(F.col(lon), F.col(lat), box))


def boxes_intersect(df: DataFrame, box: Box, columns: Sequence[str] = ("west", "south", "east", "north")) -> DataFrame:
    """Rows whose box touches the query's."""
    w, s, e, n = map(F.col, columns)
    return df.where((w <= box[2]) & (e >= box[0]) & (s <= box[3]) & (n >= box[1]))


def boxes_within(df: DataFrame, box: Box, columns: Sequence[str] = ("west", "south", "east", "north")) -> DataFrame:
    """Rows whose box lies inside the query's."""
    w, s, e, n = map(F.col, columns)
    return df.where((w >= box[0]) & (e <= box[2]) & (s >= box[1]) & (n <= box[3]))


def nearest(df: DataFrame, point: tuple[float, float], k: int, id_col: str = "id", lon: str = "lon", lat: str = "lat") -> DataFrame:
    return df.withColumn("distance", haversine(F.col(lon), F.col(lat), F.lit(point[0]), F.lit(point[1]))).orderBy("distance", id_col).limit(k)


def put_points(df: DataFrame, new: DataFrame, id_col: str = "id", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """df with the points of `new` added, or replaced where the id is known; a place that isn't on the globe is an error."""
    there = F.col(lon).between(-180, 180) & F.col(lat).between(-90, 90) | F.col(lon).isNull() | F.col(lat).isNull()
    checked = new.withColumn(lon, F.when(there, F.col(lon)).otherwise(F.raise_error(F.lit("not a place on the globe")).cast("double")))
    return df.join(new.select(id_col).distinct(), id_col, "left_anti").select(*df.columns).unionByName(checked, allowMissingColumns=True)


def delete_points(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return df.join(ids.select(id_col).distinct(), id_col, "left_anti").select(*df.columns)


def in_polygon(lon: Column, lat: Column, rings: Sequence[Ring]) -> Column:
    """Whether a point is inside a polygon of an outer ring and holes, or a multipolygon given as all of its rings (even-odd rule)."""
    inside = [in_ring(lon, lat, r).cast("int") for r in rings]
    return F.pmod(reduce(lambda a, b: a + b, inside), F.lit(2)) == 1


def _segment_distance(lon: Column, lat: Column, a: tuple[float, float], b: tuple[float, float]) -> Column:
    """Metres from a point to a segment, on the plane that touches the globe at the point."""
    k = math.pi / 180 * EARTH_M
    x = lambda p: (F.lit(float(p[0])) - lon) * k * F.cos(F.radians(lat))
    y = lambda p: (F.lit(float(p[1])) - lat) * k
    dx, dy = x(b) - x(a), y(b) - y(a)
    long = F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(x(a) * dx + y(a) * dy) / long)), F.lit(0.0))
    return F.hypot(x(a) + t * dx, y(a) + t * dy)


def distance_to_line(lon: Column, lat: Column, line: Ring) -> Column:
    """Metres from a point to a line of two or more places (for distances far below the globe's size)."""
    return reduce(F.least, [_segment_distance(lon, lat, a, b) for a, b in zip(line[:-1], line[1:], strict=True)]) if len(line) > 2 else _segment_distance(lon, lat, *line)
