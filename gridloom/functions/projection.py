"""Projections as expressions of columns: transverse Mercator zones (WGS 84) by the published Krueger series, and web Mercator."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ellipsoid (semi-major axis, flattening), the scale of a zone's centre, false easting and the south's false northing.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, EAST, SOUTH = 0.9996, 500000.0, 10000000.0

_N = FLATTENING / (2 - FLATTENING)
_RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = 2 * math.sqrt(_N) / (1 + _N)
#: Coefficients of the series to the third order: to the plane, from it, and from the conformal to the geographic latitude.
_TO = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_FROM = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm_forward(lon: Column, lat: Column, zone: Column, south: Column | None = None) -> tuple[Column, Column]:
    """Easting and northing of degrees in a zone, of the north or the south."""
    d = F.radians(lon - (zone * 6 - 183))
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - F.lit(_E) * F.atanh(F.lit(_E) * s))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(_TO, 1):
        east = east + F.lit(c) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + F.lit(c) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    shift = F.lit(0.0) if south is None else F.when(south, F.lit(SOUTH)).otherwise(F.lit(0.0))
    return F.lit(EAST) + F.lit(SCALE * _RADIUS) * east, shift + F.lit(SCALE * _RADIUS) * north


def utm_inverse(east: Column, north: Column, zone: Column, south: Column | None = None) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of an easting and northing."""
    shift = F.lit(0.0) if south is None else F.when(south, F.lit(SOUTH)).otherwise(F.lit(0.0))
    xi, eta = (north - shift) / F.lit(SCALE * _RADIUS), (east - F.lit(EAST)) / F.lit(SCALE * _RADIUS)
    across, up = eta, xi
    for j, c in enumerate(_FROM, 1):
        up = up - F.lit(c) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        across = across - F.lit(c) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    conformal = F.asin(F.sin(up) / F.cosh(across))
    lat = conformal
    for j, c in enumerate(_LATITUDE, 1):
        lat = lat + F.lit(c) * F.sin(2 * j * conformal)
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(across), F.cos(up))), F.degrees(lat)


def mercator_forward(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Web Mercator of degrees, as shares of the world: x from 0 (west) to 1, y from 0 (north) to 1."""
    return (lon + 180) / 360, (1 - F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) / math.pi) / 2


def mercator_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    return x * 360 - 180, F.degrees(2 * F.atan(F.exp((1 - 2 * y) * math.pi)) - math.pi / 2)
