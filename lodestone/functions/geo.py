"""Rectangles (closed, x is longitude, y latitude) and great-circle distance."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0
#: Metres of a degree in the approximate box of a radius.
DEGREE_M = 111000.0

SIDES = ("min_x", "min_y", "max_x", "max_y")


def rect(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(prefix + s) for s in SIDES)


def intersects(a: tuple, b: tuple) -> Column:
    """Touching counts."""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def contains(a: tuple, b: tuple) -> Column:
    return (a[0] <= b[0]) & (a[1] <= b[1]) & (a[2] >= b[2]) & (a[3] >= b[3])


def union(a: tuple, b: tuple) -> tuple[Column, ...]:
    return F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])


def area(a: tuple) -> Column:
    """0 for a rectangle whose sides are swapped."""
    w, h = a[2] - a[0], a[3] - a[1]
    return F.when((w < 0) | (h < 0), F.lit(0.0)).otherwise(w * h)


def enlargement(a: tuple, b: tuple) -> Column:
    return area(union(a, b)) - area(a)


def distance_m(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Great-circle distance from (lat0, lon0) in metres."""
    s = F.pow(F.sin(F.radians(lat - F.lit(lat0)) / 2), 2) + F.cos(F.radians(F.lit(lat0))) * F.cos(F.radians(lat)) * F.pow(F.sin(F.radians(lon - F.lit(lon0)) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(s)))


def distance_to(a: tuple, lat0: float, lon0: float) -> Column:
    """Metres from (lat0, lon0) to the nearest point of a rectangle on the sphere.

    Where the rectangle spans the centre's meridian that is a point of it. Else it
    lies on the side whose meridian is less far round the globe, at the foot of
    the perpendicular if the side reaches it, or else at the side's nearer end.
    """
    clamp = lambda v, low, high: F.greatest(low, F.least(v, high))
    spans = F.lit(False)
    for turn in (-360.0, 0.0, 360.0):
        spans = spans | ((a[0] <= lon0 + turn) & (a[2] >= lon0 + turn))
    straight = distance_m(clamp(F.lit(lat0), a[1], a[3]), F.lit(lon0), lat0, lon0)
    phi = math.radians(lat0)
    ends = []
    for side in (a[0], a[2]):
        d = F.radians(side - F.lit(lon0))
        # On a meridian d away, sin(phi) sin(x) + cos(phi) cos(x) cos(d), the cosine of the distance, is greatest here.
        foot = F.degrees(F.atan2(F.lit(math.sin(phi)), F.lit(math.cos(phi)) * F.cos(d)))
        inside = distance_m(clamp(foot, a[1], a[3]), side, lat0, lon0)
        ends.append(F.least(inside, distance_m(a[1], side, lat0, lon0), distance_m(a[3], side, lat0, lon0)))
    return F.when(spans, straight).otherwise(F.least(*ends))


def near_box(lat: float, lon: float, radius: float) -> tuple[float, float, float, float]:
    """The approximate box of a radius, in degrees."""
    dy = radius / DEGREE_M
    dx = radius / (DEGREE_M * math.cos(math.radians(lat)))
    return lon - dx, lat - dy, lon + dx, lat + dy


def cover_boxes(lat: float, lon: float, radius: float) -> list[tuple[float, float, float, float]]:
    """Boxes that hold every point within the radius, poles and the 180th meridian included."""
    angle = radius / EARTH_M
    dy = math.degrees(angle) * (1 + 1e-9) + 1e-9
    if angle >= math.pi / 2 or abs(lat) + dy >= 90:
        return [(-180.0, max(-90.0, lat - dy), 180.0, min(90.0, lat + dy))]
    dx = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat))))) * (1 + 1e-9) + 1e-9
    west, east, low, high = lon - dx, lon + dx, lat - dy, lat + dy
    if west < -180:
        return [(-180.0, low, east, high), (west + 360, low, 180.0, high)]
    if east > 180:
        return [(west, low, 180.0, high), (-180.0, low, east - 360, high)]
    return [(west, low, east, high)]
