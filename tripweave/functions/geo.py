"""Geodesy as Column expressions: everything stays inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_RADIUS_M = 6_371_000.0


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x)) if isinstance(x, (int, float)) else F.col(x)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    lat1, lon1, lat2, lon2 = (F.radians(_col(v)) for v in (lat1, lon1, lat2, lon2))
    half_dlat = F.sin((lat2 - lat1) / 2)
    half_dlon = F.sin((lon2 - lon1) / 2)
    chord = half_dlat * half_dlat + F.cos(lat1) * F.cos(lat2) * half_dlon * half_dlon
    # rounding can push antipodal points past 1, where asin would be NaN
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))


def speed_kmh(distance_m, duration_s) -> Column:
    distance_m, duration_s = _col(distance_m), _col(duration_s)
    return F.when(duration_s > 0, distance_m / duration_s * 3.6).otherwise(F.lit(0.0))


def in_geofence(lat, lon, center_lat, center_lon, radius_m) -> Column:
    return haversine_m(lat, lon, center_lat, center_lon) <= _col(radius_m)


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing from point 1 to point 2, in [0, 360)."""
    lat1, lon1, lat2, lon2 = (F.radians(_col(v)) for v in (lat1, lon1, lat2, lon2))
    dlon = lon2 - lon1
    east = F.sin(dlon) * F.cos(lat2)
    north = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def angle_diff(a, b) -> Column:
    gap = F.abs(_col(a) - _col(b))
    return F.when(gap > 180, 360 - gap).otherwise(gap)


def degree_margin(lat: float, radius_m: float) -> tuple[float, float]:
    """Half-size in degrees (lat, lon) of a box certain to hold a circle of that radius."""
    slack = 1.0 + 1e-6
    delta = radius_m / EARTH_RADIUS_M * slack + 1e-9
    cos_lat = math.cos(math.radians(lat))
    ratio = math.sin(min(delta, math.pi / 2)) / cos_lat if cos_lat > 1e-12 else 2.0
    dlon = 180.0 if ratio >= 1.0 or delta >= math.pi / 2 else math.degrees(math.asin(ratio)) * slack
    return math.degrees(delta), dlon


def corridor_distance(lat, lon, samples: list[tuple[float, float]]) -> Column:
    """Distance to the nearest sample point of a corridor; infinite when it has none."""
    if not samples:
        return F.lit(float("inf"))
    lat, lon = _col(lat), _col(lon)
    if len(samples) == 1:
        return haversine_m(lat, lon, *samples[0])
    if len(samples) <= 12:
        return F.least(*[haversine_m(lat, lon, a, b) for a, b in samples])
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in samples])
    return F.array_min(F.transform(table, lambda p: haversine_m(lat, lon, p["a"], p["b"])))
