"""Distances, boxes and grid cells on longitude and latitude columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Mean radius, used for the weights of a site graph.
MEAN_EARTH_M = 6_371_008.8
CITY = {"lat": (-38.0, -37.5), "lon": (144.5, 145.5)}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_M) -> Column:
    """Great-circle metres."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(a))


def degrees_apart(lat1, lon1, lat2, lon2) -> Column:
    """Euclidean distance in degrees, rounded to two places."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    return F.round(F.sqrt(F.pow(lat1 - lat2, 2) + F.pow(lon1 - lon2, 2)), 2)


def whole_degrees_apart(lat1, lon1, lat2, lon2) -> Column:
    """Euclidean distance between coordinates cut to whole degrees."""
    lat1, lon1, lat2, lon2 = (_c(x).cast("int") for x in (lat1, lon1, lat2, lon2))
    return F.sqrt(F.pow(lat1 - lat2, 2) + F.pow(lon1 - lon2, 2))


def box_around(lat1: float, lon1: float, lat2: float, lon2: float, margin: float = 0.2, least: float = 0.01) -> dict[str, tuple[float, float]]:
    """Box of two points, widened on each side by a share of its range, ``least`` degrees at least."""
    out = {}
    for name, a, b in (("lat", lat1, lat2), ("lon", lon1, lon2)):
        wide = max((max(a, b) - min(a, b)) * margin, least)
        out[name] = (min(a, b) - wide, max(a, b) + wide)
    return out


def in_box(lat, lon, box: dict[str, tuple[float, float]]) -> Column:
    """Inclusive membership."""
    return _c(lat).between(*map(F.lit, box["lat"])) & _c(lon).between(*map(F.lit, box["lon"]))


def wkt_point(text) -> tuple[Column, Column]:
    """(lon, lat) of ``POINT (lon lat)``; anything else gives nulls."""
    parts = [F.regexp_extract(_c(text), r"POINT\s*\(\s*(\S+)\s+(\S+)\s*\)", i) for i in (1, 2)]
    return parts[0].try_cast("double"), parts[1].try_cast("double")
