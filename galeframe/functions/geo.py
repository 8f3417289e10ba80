"""Angles and great circles as column expressions; degrees in and out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M, NM_M = 6371000.0, 1852.0


def norm360(x: Column) -> Column:
    d = x % F.lit(360.0)
    return F.when(d < 0, d + F.lit(360.0)).otherwise(d)


def norm_lon(x: Column) -> Column:
    return norm360(x + F.lit(180.0)) - F.lit(180.0)


def fold180(a: Column) -> Column:
    """An angle of [0, 360) folded to [0, 180]."""
    return F.when(a > 180, F.lit(360.0) - a).otherwise(a)


def signed(a: Column) -> Column:
    """An angle of [0, 360) as one of (-180, 180]."""
    return F.when(a > 180, a - F.lit(360.0)).otherwise(a)


def angle_between(a: Column, b: Column) -> Column:
    return fold180(norm360(a - b))


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine."""
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), F.lit(2.0)) + F.cos(p) * F.cos(q) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2.0))
    return F.lit(EARTH_M) * F.lit(2.0) * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(1.0) - h, F.lit(0.0))))


def distance_nm(*args: Column) -> Column:
    return distance_m(*args) / F.lit(NM_M)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p, q, d = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    return norm360(F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d))))


def destination(lat: Column, lon: Column, metres: Column, heading: Column) -> tuple[Column, Column]:
    p, d, b = F.radians(lat), metres / F.lit(EARTH_M), F.radians(heading)
    s = F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b)
    q = F.asin(s)
    out = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(q))
    return F.degrees(q), norm_lon(F.degrees(out))


def along(lat1: Column, lon1: Column, lat2: Column, lon2: Column, f: Column) -> tuple[Column, Column]:
    """The point a share f of the way; the ends outside (0, 1) and for coincident points."""
    d = distance_m(lat1, lon1, lat2, lon2) / F.lit(EARTH_M)
    p, q, l1, l2 = F.radians(lat1), F.radians(lat2), F.radians(lon1), F.radians(lon2)
    a, b = F.sin((F.lit(1.0) - f) * d) / F.nullif(F.sin(d), F.lit(0.0)), F.sin(f * d) / F.nullif(F.sin(d), F.lit(0.0))
    x = a * F.cos(p) * F.cos(l1) + b * F.cos(q) * F.cos(l2)
    y = a * F.cos(p) * F.sin(l1) + b * F.cos(q) * F.sin(l2)
    z = a * F.sin(p) + b * F.sin(q)
    lat = F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))
    lon = norm_lon(F.degrees(F.atan2(y, x)))
    pick = lambda first, last, mid: F.when((f <= 0) | (d < 1e-12), first).when(f >= 1, last).otherwise(mid)
    return pick(lat1, lat2, lat), pick(lon1, lon2, lon)


def cross_track_m(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    d = distance_m(lat1, lon1, lat, lon) / F.lit(EARTH_M)
    turn = F.radians(bearing(lat1, lon1, lat, lon)) - F.radians(bearing(lat1, lon1, lat2, lon2))
    return F.abs(F.asin(F.sin(d) * F.sin(turn)) * F.lit(EARTH_M))


def mix_angle(a: Column, b: Column, f: Column) -> Column:
    """Circular interpolation on the shorter side."""
    d = (b - a) % F.lit(360.0)
    d = F.when(d > 180, d - F.lit(360.0)).when(d < -180, d + F.lit(360.0)).otherwise(d)
    return (a + d * f + F.lit(360.0)) % F.lit(360.0)
