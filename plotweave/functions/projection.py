"""Reprojection between WGS84, UTM and web mercator as Column math (Krüger series)."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.functions.geometry import area, col, map_points

# WGS84 ellipsoid and the UTM grid.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING_SOUTH = 10000000.0

_N = FLATTENING / (2 - FLATTENING)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))
_RADIUS = SCALE * SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)


def _series(*rows: tuple[float, ...]) -> list[float]:
    return [sum(c * _N ** (k + 1) for k, c in enumerate(row)) for row in rows]


# Series coefficients in powers of the third flattening.
FORWARD = _series(
    (1 / 2, -2 / 3, 5 / 16, 41 / 180),
    (0, 13 / 48, -3 / 5, 557 / 1440),
    (0, 0, 61 / 240, -103 / 140),
    (0, 0, 0, 49561 / 161280),
)
INVERSE = _series(
    (1 / 2, -2 / 3, 37 / 96, -1 / 360),
    (0, 1 / 48, 1 / 15, -437 / 1440),
    (0, 0, 17 / 480, -37 / 840),
    (0, 0, 0, 4397 / 161280),
)
LATITUDE = _series(
    (2, -2 / 3, -2, 116 / 45),
    (0, 7 / 3, -8 / 5, -227 / 45),
    (0, 0, 56 / 15, -136 / 35),
    (0, 0, 0, 4279 / 630),
)


def epsg(crs: str | None) -> int | None:
    """EPSG code of ``EPSG:n``, ``urn:ogc:def:crs:EPSG::n`` or CRS84 names."""
    if crs is None:
        return None
    if crs.upper().endswith("CRS84"):
        return 4326
    found = re.search(r"EPSG:{1,2}(?:[\d.]*:)?(\d+)$", crs.strip(), re.IGNORECASE)
    if not found:
        raise ValueError(f"unsupported coordinate reference system: {crs}")
    return int(found.group(1))


def _zone(code: int) -> tuple[float, float]:
    """Central meridian in degrees and false northing of a UTM code."""
    return (code % 100) * 6 - 183, FALSE_NORTHING_SOUTH if code // 100 == 327 else 0.0


def is_utm(code: int) -> bool:
    return code // 100 in (326, 327) and 1 <= code % 100 <= 60


def to_utm(lon: Column, lat: Column, code: int) -> tuple[Column, Column]:
    meridian, north = _zone(code)
    sin_lat = F.sin(F.radians(lat))
    dlon = F.radians(lon - meridian)
    t = F.sinh(F.atanh(sin_lat) - _E * F.atanh(_E * sin_lat))
    xi = F.atan2(t, F.cos(dlon))
    eta = F.asinh(F.sin(dlon) / F.sqrt(t * t + F.cos(dlon) * F.cos(dlon)))
    x, y = eta, xi
    for j, c in enumerate(FORWARD, start=1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return FALSE_EASTING + _RADIUS * x, north + _RADIUS * y


def from_utm(easting: Column, northing: Column, code: int) -> tuple[Column, Column]:
    meridian, north = _zone(code)
    xi, eta = (northing - north) / _RADIUS, (easting - FALSE_EASTING) / _RADIUS
    x, y = eta, xi
    for j, c in enumerate(INVERSE, start=1):
        x = x - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    chi = F.asin(F.sin(y) / F.cosh(x))
    lat = chi
    for j, c in enumerate(LATITUDE, start=1):
        lat = lat + c * F.sin(2 * j * chi)
    return meridian + F.degrees(F.atan2(F.sinh(x), F.cos(y))), F.degrees(lat)


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / SEMI_MAJOR), F.degrees(2 * F.atan(F.exp(y / SEMI_MAJOR)) - math.pi / 2)


def to_wgs84(geom, crs: str) -> Column:
    """Reproject a geometry column to EPSG:4326."""
    code = epsg(crs)
    if code == 4326:
        return col(geom)
    if code == 3857:
        return map_points(geom, from_web_mercator)
    if code is not None and is_utm(code):
        return map_points(geom, lambda x, y: from_utm(x, y, code))
    raise ValueError(f"unsupported coordinate reference system: {crs}")


def with_area_utm(df: DataFrame, geom: str = "geom", name: str = "area", code: int = 32643) -> DataFrame:
    """Add square metres of a WGS84 geometry on a UTM grid (zone 43N by default)."""
    df = df.withColumn("_metric", map_points(geom, lambda x, y: to_utm(x, y, code)))
    return df.withColumn(name, area("_metric")).drop("_metric")
