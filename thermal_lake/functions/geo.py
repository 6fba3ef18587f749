"""Geodesy and cells as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0088


def haversine_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance without longitude wrap (evaluation); held to 1 inside the arcsine, so rounding can't give NaN."""
    a, b = F.radians(lat_a), F.radians(lat_b)
    dlat, dlon = b - a, F.radians(lon_b - lon_a)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * RADIUS_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def haversine_wrapped_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance whose longitude difference is wrapped to 180 degrees (tracking, regridding)."""
    wrapped = F.pmod(lon_b - lon_a + 180.0, F.lit(360.0)) - 180.0
    return haversine_km(lat_a, F.lit(0.0), lat_b, wrapped)


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    a, o = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a)


def chord(distance_km: float) -> float:
    """The straight-line distance on the unit sphere for a distance on the ground."""
    import math

    return max(2 * math.sin(min(distance_km / RADIUS_KM, math.pi) / 2), math.ulp(1.0))


def sphere_cells(lat: Column, lon: Column, distance_km: float) -> list[Column]:
    """Cell numbers of the unit vector, with an edge of the distance's chord: points that near are in neighbouring cells at most."""
    return [F.floor((x + 1.0) / chord(distance_km)) for x in unit_vector(lat, lon)]


def region_cell(lat: Column, lon: Column) -> Column:
    """The name of the 2-degree cell, like lat+34_lon-120."""
    edge = lambda x: (F.floor(x / 2) * 2).cast("int")
    return F.format_string("lat%+03d_lon%+04d", edge(lat), edge(lon))


def circular_mean_degrees(lon: Column) -> Column:
    """Aggregate: the mean direction of longitudes."""
    return F.degrees(F.atan2(F.sum(F.sin(F.radians(lon))), F.sum(F.cos(F.radians(lon)))))


def circular_hours(a: Column, b: Column) -> Column:
    """The difference of two hours of the day, 12 at most."""
    d = F.abs(a - b)
    return F.least(d, 24 - d)


def geostationary_inverse(x: Column, y: Column, height: float, lon0: float, semi_major: float, semi_minor: float) -> tuple[Column, Column]:
    """Latitude and longitude in degrees of scan angles in radians (sweep x); NULL off the Earth."""
    big = height + semi_major
    r2 = (semi_major / semi_minor) ** 2
    a = F.pow(F.sin(x), 2) + F.pow(F.cos(x), 2) * (F.pow(F.cos(y), 2) + r2 * F.pow(F.sin(y), 2))
    b = -2.0 * big * F.cos(x) * F.cos(y)
    d = b * b - 4 * a * (big**2 - semi_major**2)
    rs = (-b - F.sqrt(F.when(d >= 0, d))) / (2 * a)
    sx, sy, sz = rs * F.cos(x) * F.cos(y), -rs * F.sin(x), rs * F.cos(x) * F.sin(y)
    lat = F.degrees(F.atan(r2 * sz / F.sqrt(F.pow(F.lit(big) - sx, 2) + sy * sy)))
    lon = lon0 - F.degrees(F.atan2(sy, F.lit(big) - sx))
    return lat, F.when(lon < -180, lon + 360).when(lon > 180, lon - 360).otherwise(lon)


def geostationary_forward(lat: Column, lon: Column, height: float, lon0: float, semi_major: float, semi_minor: float) -> tuple[Column, Column]:
    """Scan angles in radians (x, y; sweep x) of a place; NULL where the satellite can't see it."""
    big = height + semi_major
    e2 = 1 - (semi_minor / semi_major) ** 2
    phi = F.atan((semi_minor / semi_major) ** 2 * F.tan(F.radians(lat)))
    rc = semi_minor / F.sqrt(1 - e2 * F.pow(F.cos(phi), 2))
    d = F.radians(lon - lon0)
    sx, sy, sz = big - rc * F.cos(phi) * F.cos(d), -rc * F.cos(phi) * F.sin(d), rc * F.sin(phi)
    seen = big * (big - sx) >= sy * sy + (semi_major / semi_minor) ** 2 * sz * sz
    x = F.asin(-sy / F.sqrt(sx * sx + sy * sy + sz * sz))
    return F.when(seen, x), F.when(seen, F.atan(sz / sx))
