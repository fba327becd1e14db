"""Albers equal-area coordinates (EPSG:5070) as column expressions: Snyder (1987), no user-defined function."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ellipsoid GRS80, standard parallels, origin.
AXIS, FLATTENING = 6378137.0, 1 / 298.257222101
PARALLEL_1, PARALLEL_2, ORIGIN_LAT, ORIGIN_LON = (math.radians(d) for d in (29.5, 45.5, 23.0, -96.0))

_E2 = FLATTENING * (2 - FLATTENING)
_E = math.sqrt(_E2)


def _q(lat: float) -> float:
    s = math.sin(lat)
    return (1 - _E2) * (s / (1 - _E2 * s * s) - math.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))


def _m(lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - _E2 * math.sin(lat) ** 2)


CONE = (_m(PARALLEL_1) ** 2 - _m(PARALLEL_2) ** 2) / (_q(PARALLEL_2) - _q(PARALLEL_1))
CONSTANT = _m(PARALLEL_1) ** 2 + CONE * _q(PARALLEL_1)
RADIUS_0 = AXIS * math.sqrt(CONSTANT - CONE * _q(ORIGIN_LAT)) / CONE


def to_albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(x, y) in metres of degrees."""
    s = F.sin(F.radians(lat))
    q = (1 - _E2) * (s / (1 - _E2 * s * s) - F.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))
    rho = AXIS * F.sqrt(CONSTANT - CONE * q) / CONE
    theta = CONE * (F.radians(lon) - ORIGIN_LON)
    return rho * F.sin(theta), RADIUS_0 - rho * F.cos(theta)


def to_lonlat(x: Column, y: Column, steps: int = 6) -> tuple[Column, Column]:
    """(lon, lat) in degrees of metres; the latitude by `steps` fixed iterations."""
    rho = F.sqrt(x * x + (RADIUS_0 - y) * (RADIUS_0 - y))
    lon = F.degrees(F.lit(ORIGIN_LON) + F.atan2(x, RADIUS_0 - y) / CONE)
    q = (F.lit(CONSTANT) - rho * rho * (CONE * CONE) / (AXIS * AXIS)) / CONE

    def step(lat: Column) -> Column:
        s = F.sin(lat)
        part = F.lit(1.0) - s * s * _E2
        return lat + part * part / (F.cos(lat) * 2) * (q / (1 - _E2) - s / part + F.log((F.lit(1.0) - s * _E) / (F.lit(1.0) + s * _E)) / (2 * _E))

    # each step is bound to a lambda variable: written out, the expression would grow fivefold a step
    start = F.array(F.asin(q / 2))
    return lon, F.degrees(F.get(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda acc, _: F.transform(acc, step)), F.lit(0)))


#: Systems that coordinates can be moved between; those in degrees are taken as one, datum shifts of a metre or two being left out.
DEGREES, METRES = ("EPSG:4269", "EPSG:4326", "OGC:CRS84"), ("EPSG:5070",)


def transform(x: Column, y: Column, crs: str, to: str) -> tuple[Column, Column]:
    """(x, y) of one system in another; unknown systems are refused unless they are the same."""
    if crs == to or crs in DEGREES and to in DEGREES:
        return x, y
    if crs in DEGREES and to in METRES:
        return to_albers(x, y)
    if crs in METRES and to in DEGREES:
        return to_lonlat(x, y)
    raise ValueError(f"no way from {crs} to {to}: {', '.join(DEGREES + METRES)} are known")
