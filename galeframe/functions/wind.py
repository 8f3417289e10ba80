"""Wind vectors, grid coordinates, and the closed-form synthetic wind field."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from galeframe.functions.geo import norm360
from galeframe.functions.units import KNOTS_TO_MS, clamp


def from_uv(u: Column, v: Column) -> tuple[Column, Column]:
    """(speed, direction the wind comes from); calm is (0, 0)."""
    s = F.hypot(u, v)
    d = F.lit(270.0) - F.degrees(F.atan2(v, u))
    return F.when(s < 1e-6, F.lit(0.0)).otherwise(s), F.when(s < 1e-6, F.lit(0.0)).otherwise(norm360(d))


def to_uv(s: Column, d: Column) -> tuple[Column, Column]:
    return -s * F.sin(F.radians(d)), -s * F.cos(F.radians(d))


def coming_from(u: Column, v: Column) -> Column:
    """Where a wind comes from; signs of zeros count, as IEEE's arc tangent has it (Spark's takes -0.0 for 0.0)."""
    turned = (u == 0) & (v == 0) & (v.cast("string") == "0.0")
    return norm360(F.when(turned, F.lit(180.0)).otherwise(F.degrees(F.atan2(-u, -v))))


def condition(u: Column, v: Column) -> tuple[Column, Column]:
    """(true wind speed in knots, direction); no guard for calm."""
    return F.hypot(u, v) / F.lit(KNOTS_TO_MS), coming_from(u, v)


def grid_coords(lat: Column, lon: Column, lat_start: float, lat_step: float, nlats: int, lon_start: float, lon_step: float, nlons: int, descending: bool = True) -> dict[str, Column]:
    """i0, i1, j0, j1 and the fractions u, v; latitudes clamp, longitudes wrap."""
    east = norm360(lon) if lon_start >= 0 else norm360(lon + F.lit(180.0)) - F.lit(180.0)
    clamped = clamp(lat, -90.0, 90.0)
    y = ((F.lit(lat_start) - clamped) if descending else (clamped - F.lit(lat_start))) / F.lit(lat_step)
    i0 = clamp(F.floor(y), 0, max(nlats - 2, 0)).cast("int")
    x = (east - F.lit(lon_start)) / F.lit(lon_step)
    j0 = F.pmod(F.floor(x), F.lit(nlons)).cast("int")
    return {
        "i0": i0, "i1": F.least(i0 + 1, F.lit(nlats - 1)), "j0": j0, "j1": ((j0 + 1) % nlons).cast("int"),
        "u": clamp(y - i0, 0.0, 1.0), "v": clamp(x - F.floor(x), 0.0, 1.0),
    }


#: Systems of the synthetic field, (lat, lon, turning, knots, spread, reach) with lat and lon as functions of the hour.
_PI = math.pi
SYSTEMS = (
    (lambda h: F.lit(50.0) + 3.0 * F.sin(h * _PI / 48.0), lambda h: F.lit(-55.0) + h / 24.0 * 7.5, 1, 14.0, 80.0, 25.0),
    (lambda h: F.lit(52.0) + 2.5 * F.cos(h * _PI / 60.0), lambda h: F.lit(-155.0) + h / 24.0 * 6.5, 1, 14.0, 80.0, 25.0),
    (lambda h: F.lit(32.0) + 1.0 * F.sin(h * _PI / 96.0), lambda h: F.lit(-42.0) + 1.5 * F.cos(h * _PI / 72.0), -1, 7.5, 140.0, 30.0),
    (lambda h: F.lit(36.0) + 1.2 * F.cos(h * _PI / 96.0), lambda h: F.lit(-140.0) + 2.0 * F.sin(h * _PI / 80.0), -1, 8.5, 160.0, 35.0),
)


def synthetic_uv(lat: Column, lon: Column, hour: Column) -> tuple[Column, Column]:
    """(u, v) in metres a second: zonal belts, two travelling lows and two highs."""
    trade_n = F.lit(9.5) + 2.0 * F.sin(lat * _PI / 30.0)
    trade_s = F.lit(8.0) + 2.0 * F.sin(F.abs(lat) * _PI / 30.0)
    wave = F.sin((lon + hour * 1.5) * _PI / 45.0)
    part = (lat - 30.0) / 8.0
    belts = [
        ((lat >= 0) & (lat <= 30), -trade_n * math.sin(math.radians(65)), -trade_n * math.cos(math.radians(65))),
        ((lat > 30) & (lat <= 38), F.lit(4.0) + 4.0 * part, F.lit(3.5) + 2.5 * wave),
        ((lat > 38) & (lat <= 65), F.lit(9.0) + 8.5 * F.sin((lat - 38.0) / 27.0 * _PI), F.lit(3.0) + 2.5 * wave),
        ((lat >= -30) & (lat < 0), -trade_s * math.sin(math.radians(60)), trade_s * math.cos(math.radians(60))),
    ]
    u, v = F.lit(12.0) + 5.0 * F.sin(F.abs(lat) * _PI / 30.0), F.lit(-2.0)
    for where, bu, bv in reversed(belts):
        u, v = F.when(where, bu).otherwise(u), F.when(where, bv).otherwise(v)
    for at_lat, at_lon, turn, knots, spread, reach in SYSTEMS:
        dy, dx = lat - at_lat(hour), lon - at_lon(hour)
        d = F.hypot(dy, dx)
        s = F.when(d < reach, F.lit(knots) * F.exp(-(d * d) / spread)).otherwise(F.lit(0.0))
        a = F.atan2(dy, dx)
        u, v = u - turn * s * F.sin(a), v + turn * s * F.cos(a)
    return u * F.lit(KNOTS_TO_MS), v * F.lit(KNOTS_TO_MS)
