"""Great-circle distance and the box that holds a radius, as column expressions."""

from __future__ import annotations

from math import cos, degrees, radians

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth in miles, a fixed value.
MILES = 3958.8


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Miles between two points; null where a coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * MILES * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def box(lat: float, lon: float, miles: float) -> tuple[float, float, float, float]:
    """South, north, west and east of a box around all points within the radius."""
    d = degrees(miles / MILES) + 1e-6
    narrow = cos(radians(min(89.9, abs(lat) + d)))
    wide = min(180.0, d / narrow) if abs(lat) + d < 89 else 180.0
    return lat - d, lat + d, lon - wide, lon + wide


def in_box(lat: Column, lon: Column, at: tuple[float, float], miles: float) -> Column:
    """The cheap test before the distance; a filter on plain columns, so a scan can take it over."""
    s, n, w, e = box(*at, miles)
    across = F.lit(True) if e - w >= 360 else lon.between(w, e) if -180 <= w and e <= 180 else (lon >= (w + 540) % 360 - 180) | (lon <= (e + 540) % 360 - 180)
    return lat.between(s, n) & across
