"""Spherical and planar geometry on columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
CIRCLE_STEPS = 64


def _col(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    chord = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(
        half_lon
    ) * F.sin(half_lon)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(chord)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, 0 to 360."""
    turn = F.radians(lon2 - lon1)
    from_lat, to_lat = F.radians(lat1), F.radians(lat2)
    east = F.sin(turn) * F.cos(to_lat)
    north = F.cos(from_lat) * F.sin(to_lat) - F.sin(from_lat) * F.cos(to_lat) * F.cos(turn)
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def destination(lat: Column, lon: Column, bearing: Column, metres: Column) -> Column:
    """Struct (longitude, latitude) reached from a point along a bearing."""
    angle = _col(metres) / EARTH_RADIUS_M
    course, from_lat = F.radians(_col(bearing)), F.radians(lat)
    sin_to = F.sin(from_lat) * F.cos(angle) + F.cos(from_lat) * F.sin(angle) * F.cos(course)
    shift = F.atan2(F.sin(course) * F.sin(angle) * F.cos(from_lat), F.cos(angle) - F.sin(from_lat) * sin_to)
    to_lon = F.pmod(F.degrees(F.radians(lon) + shift) + 540.0, F.lit(360.0)) - 180.0
    return F.struct(to_lon.alias("longitude"), F.degrees(F.asin(sin_to)).alias("latitude"))


def rounded(value: Column, digits: int) -> Column:
    """``F.round``, without a decimal per value where scaled numbers have room for halves."""
    scale = F.lit(10.0**digits)
    whole = F.floor(F.abs(value) * scale + 0.5)
    small = F.abs(value) < 2.0**51 / 10.0**digits
    return F.when(small, F.when(value < 0, -whole).otherwise(whole) / scale).otherwise(F.round(value, digits))


def circle_ring(lat: Column, lon: Column, radius_m: Column, steps: int = CIRCLE_STEPS) -> Column:
    """Closed ring of points around a fix; the radius is at least one metre."""
    radius = F.greatest(_col(radius_m), F.lit(1.0))
    return F.transform(
        F.sequence(F.lit(0), F.lit(steps)),
        lambda i: destination(lat, lon, i.cast("double") * (360.0 / steps), radius),
    )


def near_degrees(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float) -> Column:
    """Planar closeness in degrees, bound included."""
    return (lon1 - lon2) * (lon1 - lon2) + (lat1 - lat2) * (lat1 - lat2) <= F.lit(radius * radius)


def in_bbox(lon: Column, lat: Column, bbox: tuple[float, float, float, float]) -> Column:
    west, south, east, north = bbox
    return lon.between(west, east) & lat.between(south, north)


def bbox_overlap(a: tuple[Column, ...], b: tuple[Column, ...], touching: bool = False) -> Column:
    """Overlap of two (west, south, east, north) boxes; ``touching`` counts shared edges."""
    if touching:
        return (a[2] >= b[0]) & (a[0] <= b[2]) & (a[3] >= b[1]) & (a[1] <= b[3])
    return (a[0] < b[2]) & (a[2] > b[0]) & (a[1] < b[3]) & (a[3] > b[1])


def cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size)).cast("long")


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Planar distance from a point to a segment."""
    dx, dy = bx - ax, by - ay
    squared = dx * dx + dy * dy
    along = F.when(squared > 0, ((px - ax) * dx + (py - ay) * dy) / squared).otherwise(F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), along))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def tile_x(lon: Column, zoom: Column | int) -> Column:
    """Column of the web-map tile; the fraction is cut towards zero."""
    return ((lon + 180.0) / 360.0 * F.pow(F.lit(2.0), _col(zoom))).cast("long")


def tile_y(lat: Column, zoom: Column | int) -> Column:
    fraction = (F.lit(1.0) - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0
    return (fraction * F.pow(F.lit(2.0), _col(zoom))).cast("long")


def tile_bounds(x: Column, y: Column, zoom: Column | int) -> Column:
    """Struct (west, south, east, north) of a tile."""
    n = F.pow(F.lit(2.0), _col(zoom))

    def lat_of(row: Column) -> Column:
        return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - 2.0 * row / n))))

    return F.struct(
        (x / n * 360.0 - 180.0).alias("west"),
        lat_of(y + 1).alias("south"),
        ((x + 1) / n * 360.0 - 180.0).alias("east"),
        lat_of(y).alias("north"),
    )
